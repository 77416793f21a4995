"""Main body of pages: boosted trees over the nodes of a page, decoded from the root down.

Stored pages have lost their tags but not their tree: the page has blocks (parted by blank lines), blocks have lines. A
line's features are its own density and tokens (attribute tokens of the tree's place: bullets, pipes, arrows, the site's
own name, what its words say), its depth and position, and statistics of its siblings and neighbours. Trees are fitted on
the lines of all pages, labelled by signals that look at no wording: that a line comes back in other pages, names
its site or is a row of names, or is long prose or holds words that hardly any page has. Lines without a signal are left to
the trees. What comes back and what is rare is counted over all pages and measured as a share of them. Decoding goes from the page to its blocks to their lines: a dropped block drops all its lines, a kept block keeps
at least one.
"""

from __future__ import annotations

import math
import pickle
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapisan.config import small_rows, written
from tapisan.llm.boosting import BoostedTrees, Circle, Part, codes
from tapisan.llm.lines import DIGITS, MONTHS
from tapisan.llm.text import SPACE, site_col, words

MARKER = re.compile(r"^(?:([›»>|]+|\*\*)|([*•–-])|(\d+[.)])|(\d+)\s)\s*")
ENDS, ITEM, LETTERS = re.compile(r"[.!?](?:\s|$)"), re.compile(r"^(?:[*•–-]|\d+[.)])\s+[a-zà-ÿ]"), re.compile(r"[^\W\d_]+")
_LETTERS = bytes(c if chr(c).isalpha() and c < 128 else 32 for c in range(256))
#: Features of a line: its own, of which those of ODDS need the odds of its words, and from PLACE on those of its place.
N_FEATURES, ODDS, PLACE = 40, range(19, 24), 26
FIXED = [f for f in range(PLACE) if f not in ODDS]
#: Pages from which a form, or a form without its uncommon words, comes back; pages below which a word is rare. They are of
#: up to OUT_OF pages; of more pages they are the same share.
FORM_PAGES, SKELETON_PAGES, RARE_PAGES, OUT_OF = 4, 5, 3, 1500
#: Share of the pages from which a word is common; characters from which a line is long.
COMMON, LONG = 0.01, 120
#: Counts that a task keeps before it passes them on; lines in a row of the table of features, and those that are counted at a time; short lines, words' skeletons that a task keeps.
KEPT_COUNTS, ROW_LINES, COUNT_LINES, KEPT_LINES, KEPT_WORDS = 300_000, 4096, 65_536, 200_000, 400_000
#: Bounds of what is read to the driver: words and keys that are so frequent a share of the pages, and codes of features.
MOST_SHARED, MOST_CELLS = 2_000_000, N_FEATURES * 2**16


def blocks(text: str | None) -> list[list[str]]:
    """Blocks of stripped lines that aren't blank."""
    out: list[list[str]] = [[]]
    for x in text.split("\n") if text else ():
        x = x.strip(SPACE)
        if x:
            out[-1].append(x)
        elif out[-1]:
            out.append([])
    return out if out[-1] else out[:-1]


@lru_cache(10_000)
def squeezed(site: str | None) -> str:
    """The site's own name as it stands in its host."""
    return re.sub(r"[\W_]+", "", (site or "").rsplit(".", 1)[0].rsplit(".", 1)[-1])


def share(least: int, pages: int) -> float:
    """`least` of OUT_OF pages as a number of so many pages, not under `least`."""
    return max(least, least * pages / OUT_OF)


def page_words(bs: list[list[str]]) -> set[str]:
    return set().union(*[words(x) for b in bs for x in b])


def runs(line: str) -> list[str]:
    """Runs of letters."""
    return line.encode().translate(_LETTERS).decode().split() if line.isascii() else LETTERS.findall(line)


class Seen(NamedTuple):
    """Lines of pages by what is known before the odds of words are."""

    #: 1 around, 0 body, -1 unknown; how many different words of letters; lines x FIXED; numbers of the words that aren't rare, line after line, and how many a line has.
    labels: np.ndarray
    alphas: np.ndarray
    fixed: np.ndarray
    words: np.ndarray
    sizes: np.ndarray


def read(site: str | None, line: str, numbers: dict[str, int]) -> tuple[list[str], set[str], set[str], bool, bool, list, bytes]:
    """A line's words, the different ones, those without a number, whether all are letters, whether they name the site, its features FIXED and its words' numbers."""
    name, raw, ws = squeezed(site), line.split(), words(line)
    found, joined, count, last, m = set(ws), "".join(ws), line.count, line[-1], MARKER.match(line)
    plain, named = joined.isalpha(), bool(name) and name in joined
    caps = len([w for w in raw[1:] if w[0].isupper()])
    known = array("i", filter(None, map(numbers.get, found)))
    rare = found.difference(numbers) if len(known) < len(found) else set()
    lower = len([w for w in raw if w in rare and w.islower() and w.isalpha()]) if rare else 0
    fixed = [
        len(line), len(ws), caps, caps / max(1, len(raw) - 1), line.isupper(), 0 if plain else sum(map(str.isdigit, ws)),
        last in ".!?”\"", last == "?", last == ".", count("|"), count(" > ") + count("»") + count(" / "), count(":"), count(","), " - " in line, "(" in line, "©" in line,
        m.lastindex or 0 if m else 0, lower, lower / max(1, len(raw)), named, count(". ") + 1,
    ]
    return ws, found, rare, plain, named, fixed, known.tobytes()


def seen_lines(line: Callable[[str | None, str], tuple], sites: list[str | None], pages: list[list[list[str]]], cache: dict | None = None) -> Seen:
    """line: gives the parts of a line."""
    cache = {} if cache is None else cache
    labels, alphas, fixed, numbers, sizes = array("b"), array("i"), array("f"), array("i"), array("i")
    for site, bs in zip(sites, pages):
        for b in bs:
            for x in b:
                hit = cache.get((site, x))
                if hit is None:
                    hit = line(site, x)
                    if len(x) < 120:
                        cache[site, x] = hit
                label, n, own, found = hit
                labels.append(label)
                alphas.append(n)
                fixed.frombytes(own)
                numbers.frombytes(found)
                sizes.append(len(found) // numbers.itemsize)
    return Seen(np.array(labels, np.int8), np.array(alphas, np.int64), np.array(fixed, np.float32).reshape(-1, len(FIXED)), np.array(numbers, np.int32), np.array(sizes, np.int32))


class Skeletons(dict):
    """What stands for a word in a skeleton."""

    def __init__(self, common: set[str]):
        super().__init__((w, w) for w in common)

    def __missing__(self, w: str) -> str:
        out = "0" if w.isdigit() else "_"
        if len(self) < KEPT_WORDS:
            self[w] = out
        return out


class Signals:
    """What all pages tell of a line without looking at its wording. Made from pages, or from counts over a table by `words` and `keys`."""

    def __init__(self, pages: list[tuple[str | None, list[list[str]]]] = ()):
        found = Counter()
        for _, bs in pages:
            found.update(page_words(bs))
        self.with_words(found, len(pages))
        keys = Counter()
        for s, bs in pages:
            keys.update(self.page_keys(s, bs))
        self.with_keys(keys)

    def with_words(self, found: dict[str, int], pages: int) -> Signals:
        """found: pages of each word; rare ones are left out."""
        self.n, rare, common = pages, share(RARE_PAGES, pages), max(share(RARE_PAGES, pages), COMMON * pages)
        self.pages = {w: n for w, n in found.items() if n >= rare}
        self.common = {w for w, n in self.pages.items() if n >= common and not w.isdigit()}
        self.skeletons, self.numbers = Skeletons(self.common), {w: i for i, w in enumerate(self.pages, 1)}
        self.others = np.array([i for w, i in self.numbers.items() if not w.isalpha()], np.int64)
        return self

    def with_keys(self, found: dict[int, int]) -> Signals:
        """found: pages of each key; those of forms are even, those of skeletons odd."""
        least = share(FORM_PAGES, self.n), share(SKELETON_PAGES, self.n)
        self.hot = {k for k, n in found.items() if n >= least[k & 1]}
        return self

    def skeleton(self, ws: list[str]) -> str:
        """The line's words with numbers as 0 and uncommon words as _."""
        return " ".join(map(self.skeletons.__getitem__, ws))

    @staticmethod
    def form_key(site: str | None, ws: list[str], plain: bool = False) -> int:
        """plain: no word has a digit."""
        form = " ".join(ws)
        return (xxhash.xxh3_64_intdigest(f"{site or ''}\0{form if plain else DIGITS.sub('0', form)}") >> 2) << 1

    def skeleton_key(self, ws: list[str]) -> int:
        return (xxhash.xxh3_64_intdigest(self.skeleton(ws)) >> 2) << 1 | 1

    def page_keys(self, site: str | None, bs: list[list[str]]) -> set[int]:
        out = set()
        for b in bs:
            for x in b:
                ws = words(x)
                out.add(self.form_key(site, ws, "".join(ws).isalpha()))
                out.add(self.skeleton_key(ws))
        return out

    def says_its_own(self, line: str, found: set[str], plain: bool, rare: set[str] | None = None) -> bool:
        """Whether a run of at least three small letters, no month, is rare. found: the line's words; plain: they have no digit; rare: those that are."""
        pages = self.pages
        rare = [w for w in (found.difference(pages) if rare is None else rare) if len(w) > 2 and w in line]
        if rare:
            padded = f" {line} "
            for w in rare:
                if f" {w} " in padded and w.isalpha() and w.islower() and not MONTHS.match(w):
                    return True
        elif line.isascii() and (plain or all([w.isalpha() or w.isdigit() for w in found])):
            return False  # every run of letters is a word
        return any([w not in pages and len(w) > 2 and w.islower() and not MONTHS.match(w) for w in runs(line)])

    def label(self, site: str | None, line: str) -> int | None:
        """1 around, 0 body, None unknown; the first signal counts."""
        label = self.line(site, line)[0]
        return None if label < 0 else label

    def line(self, site: str | None, line: str) -> tuple[int, int, bytes, bytes]:
        """What `Seen` has of a line."""
        ws, found, rare, plain, named, fixed, known = read(site, line, self.numbers)
        short = len(line) < LONG + 20
        if short and named:
            label = 1  # speaks of its site
        elif self.form_key(site, ws, plain) in self.hot:
            label = 1
        elif fixed[2] >= 3 and len(line.split()) >= 5 and not ENDS.search(line):
            label = 1  # a row of names, such as another page's title
        elif self.says_its_own(line, found, plain, rare):
            label = 0
        elif short and self.skeleton_key(ws) in self.hot:
            label = 1
        else:
            label = 0 if (len(line) > LONG and ENDS.search(line)) or ITEM.match(line) else -1
        return label, len(found) if plain else sum(map(str.isalpha, found)), array("f", fixed).tobytes(), known

    def said(self, seen: Seen) -> np.ndarray:
        """(inside, around) x numbers of words: labelled lines with each word of letters; at 0 all different words of letters of such lines."""
        n = len(self.numbers) + 1
        out = np.stack([np.bincount(seen.words[np.repeat(seen.labels == k, seen.sizes)], minlength=n) for k in (0, 1)])
        out[:, self.others] = 0
        out[:, 0] = [seen.alphas[seen.labels == k].sum() for k in (0, 1)]
        return out


class LineModel:
    """Word statistics and boosted trees; fitted by `fit`, applied by `marks`."""

    def __init__(self):
        self.words: dict[str, tuple[float, float]] = {}
        self.trees = BoostedTrees()

    def fit(self, texts: list[tuple[str | None, str | None]]) -> LineModel:
        """texts: (site, body) pairs."""
        sites, pages = [s for s, _ in texts], [blocks(t) for _, t in texts]
        signals = Signals(list(zip(sites, pages)))
        seen = seen_lines(signals.line, sites, pages)
        self.with_odds(signals.said(seen), signals)
        y = seen.labels
        self.trees.fit(self.features(seen, pages)[y >= 0], y[y >= 0].astype(float))
        return self

    def with_odds(self, said: np.ndarray, signals: Signals) -> LineModel:
        """said: as `Signals.said` has it."""
        body, around = said[:, 0].tolist()
        for (w, n), b, a in zip(signals.pages.items(), *said[:, 1:].tolist()):
            self.words[w] = math.log((a + 0.5) / (around + 1)) - math.log((b + 0.5) / (body + 1)), math.log(signals.n / n)
        return self

    def odds(self, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Features of ODDS: sum, greatest, least and mean of the odds of a line's words, mean of their rarity."""
        out, some = np.zeros((len(sizes), len(ODDS))), sizes > 0
        if some.any():
            odds, rarity = self.arrays[:, numbers - 1]
            first = (np.cumsum(sizes, dtype=np.int64) - sizes)[some]
            out[some, 0], out[some, 1], out[some, 2] = np.add.reduceat(odds, first), np.maximum.reduceat(odds, first), np.minimum.reduceat(odds, first)
            out[some, 3], out[some, 4] = out[some, 0] / sizes[some], np.add.reduceat(rarity, first) / sizes[some]
        return out.astype(np.float32)

    @cached_property
    def numbers(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words, 1)}

    @cached_property
    def arrays(self) -> np.ndarray:
        return np.array(list(self.words.values())).reshape(-1, 2).T

    def features(self, seen: Seen, pages: list[list[list[str]]]) -> np.ndarray:
        """Lines of all pages x N_FEATURES."""
        out = np.zeros((len(seen.labels), N_FEATURES), np.float32)
        out[:, FIXED] = seen.fixed
        out[:, ODDS] = self.odds(seen.words, seen.sizes)
        out[:, PLACE:] = placed(out[:, 0], out[:, ODDS[0]], *shape(pages))
        return out

    def line(self, site: str | None, line: str) -> tuple[int, int, bytes, bytes]:
        """What `Seen` has of a line, without a label."""
        fixed, known = read(site, line, self.numbers)[-2:]
        return -1, 0, array("f", fixed).tobytes(), known

    def marks(self, pages: list[tuple[str | None, str | None]], cache: dict | None = None) -> list[np.ndarray]:
        """For each page, which of its lines are not its own text."""
        parsed = [blocks(t) for _, t in pages]
        scores = self.trees.score(self.features(seen_lines(self.line, [s for s, _ in pages], parsed, cache), parsed))
        size, length = shape(parsed)
        return np.split(self.decoded(size, scores), np.cumsum(length)[:-1])

    @staticmethod
    def decode(bs: list[list[str]], scores: np.ndarray, apart: float = 1.0) -> np.ndarray:
        """`decoded` for lists of lines."""
        return LineModel.decoded(np.array([len(b) for b in bs], np.int64), scores, apart)

    @staticmethod
    def decoded(size: np.ndarray, scores: np.ndarray, apart: float = 1.0) -> np.ndarray:
        """Best consistent choice: a block is dropped whole, or kept with `apart` paid for each line dropped from it. size: lines of each block."""
        drop, many = scores > 0, size > 1  # of a block of one line the sign decides
        first = np.cumsum(size) - size
        for at, n in zip(first[many].tolist(), size[many].tolist()):
            s = scores[at : at + n]
            mixed = s > apart
            if mixed.all():
                mixed[int(s.argmin())] = False
            kept = np.where(mixed, s - apart, 0).sum()
            drop[at : at + n] = True if s.sum() > kept else mixed
        return drop


def shape(pages: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each block, lines of each page."""
    size, length = [len(b) for bs in pages for b in bs], [sum(map(len, bs)) for bs in pages]
    return np.array(size, np.int32), np.array(length, np.int32)


def placed(chars: np.ndarray, said: np.ndarray, size: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Features of the lines' places; chars, said: their characters and what their words say. size, length: lines of each block and of each page."""
    n = len(chars)
    out = np.zeros((n, N_FEATURES - PLACE), np.float32)
    if not n:
        return out
    length = length[length > 0]
    first = np.r_[0, np.cumsum(size)[:-1]]
    start = np.r_[0, np.cumsum(length)[:-1]]
    blk, page = np.repeat(np.arange(len(size)), size), np.repeat(np.arange(len(length)), length)
    at = np.arange(n)
    pos = at - start[page]
    top, end = pos == 0, pos == length[page] - 1
    before = lambda x: np.where(top, 0, np.r_[0, x[:-1]])
    after = lambda x: np.where(end, 0, np.r_[x[1:], 0])
    out[:, 0] = size[blk]  # siblings
    out[:, 1] = at - first[blk]  # place among them
    out[:, 2] = np.add.reduceat(chars, first)[blk] / size[blk]  # density of the parent
    out[:, 3] = np.add.reduceat(said, first)[blk] / size[blk]  # what the siblings' words say
    out[:, 4], out[:, 5], out[:, 6] = pos / length[page], pos, length[page] - 1 - pos
    out[:, 7], out[:, 8], out[:, 9], out[:, 10] = before(chars), after(chars), before(said), after(said)
    out[:, 11] = before(said)[first][blk]  # the line before the block
    out[:, 12] = chars[first][blk]
    total = np.cumsum(chars, dtype=np.float64)
    out[:, 13] = (total - (total - chars)[start][page]) / np.add.reduceat(chars, start)[page]
    return out


def counted(rows: DataFrame, found: Callable[[str | None, list[list[str]]], set], key: str, total: object) -> DataFrame:
    """(key, n): how many pages have each of what `found` gives, and as `total` all pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            for s, t in zip(b["site"], b["body"]):
                n.update(found(s, blocks(t)))
                if len(n) > KEPT_COUNTS:
                    yield pd.DataFrame({"key": list(n.keys()), "n": list(n.values())})
                    n = Counter()
            n[total] += len(b)
        yield pd.DataFrame({"key": list(n.keys()), "n": list(n.values())})

    return rows.mapInPandas(run, f"key {key}, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def signals_of(rows: DataFrame) -> Signals:
    """Signals of all pages; what is frequent enough to matter is at most the mean of a page's words, or lines, over its share."""
    signals = Signals()
    found = written(counted(rows, lambda _, bs: page_words(bs), "string", "").filter(f"n >= {RARE_PAGES} or key = ''"), "words")
    pages = sum(r["n"] for r in found.filter("key = ''").collect())
    least = found.filter(F.col("n") >= share(RARE_PAGES, pages)).filter("key != ''")
    signals.with_words({r["key"]: r["n"] for r in small_rows(least, MOST_SHARED, "words that aren't rare")}, pages)
    keys = counted(rows, signals.page_keys, "bigint", -1).filter("key >= 0")
    keys = keys.filter(F.col("n") >= F.when(F.col("key") % 2 == 0, share(FORM_PAGES, pages)).otherwise(share(SKELETON_PAGES, pages)))
    return signals.with_keys({r["key"]: r["n"] for r in small_rows(keys, MOST_SHARED, "lines that come back")})


def seen_pages(rows: DataFrame, signals: Signals) -> DataFrame:
    """What the signals tell of all lines, pages of about ROW_LINES lines to a row; besides, each task's number of labelled lines (around, inside) by word.

    `blocks` and `lines` are the lines of each block and of each page; `fixed` are the codes of FIXED, feature by feature.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        said, task, no = signals.said(seen_lines(signals.line, [], [])), TaskContext.get().partitionId(), 0
        for b in batches:
            if len(cache) > KEPT_LINES:
                cache.clear()
            parsed, out = [blocks(t) for t in b["body"]], []
            length = shape(parsed)[1].astype(np.int64)
            group = (np.cumsum(length) - length) // ROW_LINES
            cut = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(length)]
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                seen, own = seen_lines(signals.line, b["site"].iloc[i:j].tolist(), parsed[i:j], cache), parsed[i:j]
                said += signals.said(seen)
                c = np.ascontiguousarray(codes(seen.fixed).T)
                chars = seen.fixed[:, 0].astype(np.int32)
                out.append((task, no + len(out), b["id"].iloc[i:j].tolist(), *[x.tobytes() for x in (*shape(own), c, chars, seen.words, seen.sizes, seen.labels)], None, None, None))
            no += len(out)
            yield pd.DataFrame(out, columns=names)
        w = np.flatnonzero(said.any(axis=0))
        yield pd.DataFrame([(task, -1, *[None] * 8, w, said[1, w], said[0, w])], columns=names)

    names = ["task", "no", "ids", "blocks", "lines", "fixed", "chars", "words", "sizes", "labels", "word", "around", "inside"]
    of = "task int, no int, ids array<string>, blocks binary, lines binary, fixed binary, chars binary, words binary, sizes binary, labels binary, word array<bigint>, around array<bigint>, inside array<bigint>"
    return rows.mapInPandas(run, of)


def odds_of(pages: DataFrame, signals: Signals) -> LineModel:
    """A model with the word odds of the labelled lines of all pages, without trees."""
    n = pages.filter("no < 0").select(F.explode(F.arrays_zip("word", "around", "inside")).alias("x"))
    n = n.groupBy("x.word").agg(F.sum("x.around").alias("around"), F.sum("x.inside").alias("inside"))
    said = np.zeros((2, len(signals.numbers) + 1), np.int64)
    for r in small_rows(n, MOST_SHARED, "words that aren't rare"):
        said[:, r["word"]] = r["inside"], r["around"]
    return LineModel().with_odds(said, signals)


def page_features(pages: DataFrame, model: LineModel) -> DataFrame:
    """Features of all lines of `seen_pages` as codes, feature by feature; besides, each task's number of labelled lines by feature and code."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, waiting, task = np.zeros(N_FEATURES << 16, np.int64), [], TaskContext.get().partitionId()
        first = (np.arange(N_FEATURES, dtype=np.int64) << 16)[:, None]

        def count() -> None:
            if waiting:
                n[:] += np.bincount((np.concatenate(waiting, axis=1) + first).ravel(), minlength=len(n))
            waiting.clear()

        for b in batches:
            made = []
            for fixed, y, *rest in zip(b["fixed"], b["labels"], *[b[x] for x in ("blocks", "lines", "chars", "words", "sizes")]):
                size, length, chars, numbers, sizes = [np.frombuffer(x, np.int32) for x in rest]
                odds = model.odds(numbers, sizes)
                c = np.empty((N_FEATURES, len(chars)), np.uint16)
                c[FIXED], c[ODDS] = np.frombuffer(fixed, np.uint16).reshape(len(FIXED), -1), codes(odds).T
                c[PLACE:] = codes(placed(chars.astype(np.float32), odds[:, 0], size, length)).T
                made.append(c.tobytes())
                waiting.append(c[:, np.frombuffer(y, np.int8) >= 0])
                if sum(x.shape[1] for x in waiting) >= COUNT_LINES:
                    count()
            yield b[names[:6]].assign(codes=made, cells=None, n=None)
        count()
        cells = np.flatnonzero(n)
        yield pd.DataFrame([(task, -1, None, None, None, None, None, cells, n[cells])], columns=[*names[:6], "codes", "cells", "n"])

    names = ["task", "no", "ids", "blocks", "lines", "labels"]
    known = pages.filter("no >= 0").select(*names, "fixed", "chars", "words", "sizes")
    return known.mapInPandas(run, "task int, no int, ids array<string>, blocks binary, lines binary, labels binary, codes binary, cells array<bigint>, n array<bigint>")


def fit_trees(lines: DataFrame, trees: BoostedTrees) -> np.ndarray:
    """Fits the trees on the labelled lines of `page_features`, by a barrier stage of as many tasks as run at once; needs a fixed number of executors. Returns features x codes: the bin."""
    pair = F.explode(F.arrays_zip("cells", "n")).alias("x")
    found = lines.filter("no < 0").select(pair).groupBy("x.cells").agg(F.sum("x.n").alias("n"))
    cells = np.array(sorted((r["cells"], r["n"]) for r in small_rows(found, MOST_CELLS, "codes")), np.int64).reshape(-1, 2)
    of = cells[:, 0] >> 16
    bins = trees.set_edges([((cells[of == f, 0] & 0xFFFF).astype(np.uint16), cells[of == f, 1]) for f in range(N_FEATURES)])
    if not len(cells):
        trees.fit(np.zeros((0, N_FEATURES), np.float32), np.zeros(0))
        return bins

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, part = BarrierTaskContext.get(), Part(N_FEATURES)
        for b in batches:
            for c, y in zip(b["codes"], b["labels"]):
                y = np.frombuffer(y, np.int8)
                part.add(binned(bins, c)[:, y >= 0], y[y >= 0])
        circle = Circle(task)
        fitted = trees.fit_parts(part.done(), circle.me, circle)
        circle.close()
        if not circle.me:
            yield pd.DataFrame({"trees": [pickle.dumps(fitted)]})

    tasks = lines.sparkSession.sparkContext.defaultParallelism
    own = lines.filter("no >= 0").repartition(tasks, "task", "no").sortWithinPartitions("task", "no").select("codes", "labels")
    trees.__dict__.update(pickle.loads(own.mapInPandas(run, "trees binary", barrier=True).collect()[0]["trees"]).__dict__)
    return bins


def binned(bins: np.ndarray, c: bytes) -> np.ndarray:
    """Bins of codes, features x lines."""
    return np.stack([b[x] for b, x in zip(bins, np.frombuffer(c, np.uint16).reshape(N_FEATURES, -1))])


def fitted(df: DataFrame, id_col: str, body: str, url: str) -> tuple[LineModel, DataFrame, np.ndarray]:
    """A model of all pages: words and lines are counted over all of them, signals label their lines, the trees are of all labelled lines. With it the features of all lines and the bins of their codes."""
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), site_col(F.col(f"`{url}`")).alias("site"), F.col(f"`{body}`").alias("body")).filter("body is not null")
    signals = signals_of(rows.select("site", "body"))
    pages = written(seen_pages(rows, signals), "pages")
    model = odds_of(pages, signals)
    lines = written(page_features(pages, model), "lines")
    return model, lines, fit_trees(lines, model.trees)


def fit_on(df: DataFrame, id_col: str, body: str, url: str) -> LineModel:
    """A model fitted on all pages, for other pages."""
    return fitted(df, id_col, body, url)[0]


def own_surrounding_lines(df: DataFrame, id_col: str, body: str, url: str) -> DataFrame:
    """`surrounding_lines` by a model fitted on the same pages, whose features are computed once."""
    model, lines, bins = fitted(df, id_col, body, url)
    trees = model.trees

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, no = [], []
            for own, size, length, c in zip(b["ids"], b["blocks"], b["lines"], b["codes"]):
                length = np.frombuffer(length, np.int32)
                drop = np.flatnonzero(LineModel.decoded(np.frombuffer(size, np.int32), trees.score_bins(binned(bins, c))))
                page = np.repeat(np.arange(len(length)), length)[drop]
                ids += np.array(own, object)[page].tolist()
                no.append((drop - (np.cumsum(length) - length)[page] + 1).astype(np.int32))
            yield pd.DataFrame({"id": ids, "line_no": np.concatenate(no) if no else np.zeros(0, np.int32)})

    found = lines.filter("no >= 0").select("ids", "blocks", "lines", "codes").mapInPandas(run, "id string, line_no int")
    return found.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "line_no")


def surrounding_lines(df: DataFrame, id_col: str, body: str, url: str, model: LineModel) -> DataFrame:
    """(id, line_no) of the lines that aren't the page's own text. Null and blank bodies have no rows; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for b in batches:
            if len(cache) > KEPT_LINES:
                cache.clear()
            pages = list(zip(b["site"], b["body"]))
            ids, no = [], []
            for i, drop in zip(b["id"].tolist(), model.marks(pages, cache)):
                at = np.flatnonzero(drop) + 1
                ids += [i] * len(at)
                no.append(at)
            yield pd.DataFrame({"id": pd.Series(ids, dtype=b["id"].dtype), "line_no": np.concatenate(no).astype(np.int32) if no else np.zeros(0, np.int32)})

    base = df.select(F.col(f"`{id_col}`").alias("id"), site_col(F.col(f"`{url}`")).alias("site"), F.col(f"`{body}`").alias("body")).filter("body is not null")
    return base.mapInPandas(run, f"id {df.schema[id_col].dataType.simpleString()}, line_no int").withColumnRenamed("id", id_col)
