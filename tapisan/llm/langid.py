"""Language of documents and of their segments by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over
all ways to cut it in pieces (forward algorithm); piece probabilities are fitted by expectation-maximisation
(forward-backward) on a bounded sample of labelled rows, in two rounds: lines that contradict their row's label after the
first round are left out of the second, so wrong labels and foreign lines do little harm.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapisan.llm.text import lines, words

#: Longest word scored as one lattice; longer ones are scored in cuts of so many characters.
LONGEST = 30
#: Where the vocabularies of pieces lie: a sentencepiece model and byte-level ranks for many languages; their union is used.
VOCABULARY = ("/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Probability of a character that is no piece.
UNKNOWN = 1e-7


def read_pieces(paths: tuple[str, ...]) -> list[str]:
    """The pieces of some public vocabularies in lower case, without control pieces; '▁' marks the start of a word."""
    import sentencepiece

    out: set[str] = set()
    for path in paths:
        if path.endswith(".tiktoken"):
            with open(path, "rb") as f:
                raw = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
            out.update(b.decode("utf-8", "ignore").replace(" ", "▁") for b in raw)
        else:
            m = sentencepiece.SentencePieceProcessor(model_file=path)
            out.update(m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)))
    return sorted({p.lower() for p in out if re.fullmatch(r"▁?[^\W_]+|▁", p)})


class Lattice:
    """All cuts of some words into pieces, as edges ordered by their end."""

    def __init__(self, found: list[str], index: dict[str, int], longest: int):
        self.n = len(found)
        word, start, end, piece = [], [], [], []
        unknown = len(index)
        for i, w in enumerate(found):
            n = len(w)
            for s in range(n):
                for e in range(s + 1, min(n, s + longest) + 1):
                    p = index.get(w[s:e], unknown if e == s + 1 else None)
                    if p is not None:
                        word.append(i)
                        start.append(s)
                        end.append(e)
                        piece.append(p)
        self.word, self.start, self.end, self.piece = (np.array(x, np.int64) for x in (word, start, end, piece))
        self.length = np.array([len(w) for w in found], np.int64)
        order = np.argsort(self.end * self.n + self.word, kind="stable")
        self.word, self.start, self.end, self.piece = (x[order] for x in (self.word, self.start, self.end, self.piece))
        self.depth = int(self.length.max(initial=0))
        self.cuts = np.searchsorted(self.end, np.arange(self.depth + 2))

    def forward(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """theta: pieces x languages. Sums over all cuts of every prefix, and of the whole words."""
        alpha = np.zeros((self.n, self.depth + 1, theta.shape[1]))
        alpha[:, 0] = 1
        for p in range(1, self.depth + 1):
            at = slice(self.cuts[p], self.cuts[p + 1])
            w = self.word[at]
            if len(w):
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                alpha[w[first], p] = np.add.reduceat(alpha[w, self.start[at]] * theta[self.piece[at]], first, axis=0)
        return alpha, alpha[np.arange(self.n), self.length]

    def expected(self, theta: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, by language, if words come `counts` times (words x languages)."""
        alpha, whole = self.forward(theta)
        beta = np.zeros_like(alpha)
        beta[np.arange(self.n), self.length] = 1
        out = np.zeros_like(theta)
        scale = counts / np.maximum(whole, 1e-300)
        # an end's beta is complete once all edges that start there have been taken, so ends go from last to first
        by_start = np.argsort(-self.start, kind="stable")
        s = self.start[by_start]
        if not len(s):
            return out
        for lo, hi in zip(cuts := np.flatnonzero(np.r_[True, s[1:] != s[:-1]]), np.r_[cuts[1:], len(s)]):
            at = by_start[lo:hi]
            at = at[np.argsort(self.word[at], kind="stable")]
            w = self.word[at]
            step = theta[self.piece[at]] * beta[w, self.end[at]]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            beta[w[first], s[lo]] = np.add.reduceat(step, first, axis=0)
            use = alpha[w, s[lo]] * step * scale[w]
            for k in range(theta.shape[1]):
                out[:, k] += np.bincount(self.piece[at], use[:, k], len(theta))
        return out


class LanguageModel:
    """Piece probabilities of some languages; scores texts by the logarithm of their probability in each."""

    def __init__(self, languages: list[str], index: dict[str, int], theta: np.ndarray):
        self.languages, self.index, self.theta = languages, index, theta
        self.longest = max(map(len, index), default=1)
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(languages)), np.float32)

    def __getstate__(self):
        return self.languages, self.index, self.theta

    def __setstate__(self, state):
        self.__init__(*state)

    @classmethod
    def fit(cls, counts: dict[str, Counter], pieces: list[str], rounds: int = 6, shrink: float = 5.0) -> LanguageModel:
        """A piece's probability is the common one times the ratio of its uses to those expected at the common rate, both plus
        `shrink`: rare pieces, such as those of names, tell languages little apart, frequent ones as they are."""
        languages = sorted(k for k, c in counts.items() if c)
        if not languages:
            return cls([], {}, np.zeros((1, 0)))
        found = sorted({w for k in languages for w in counts[k]})
        per = np.array([[counts[k][w] for k in languages] for w in found], float).reshape(len(found), len(languages))
        cut = [cls.cuts(w) for w in found]
        flat = sorted({x for c in cut for x in c})
        at = {x: i for i, x in enumerate(flat)}
        n = np.zeros((len(flat), len(languages)))
        for i, c in enumerate(cut):
            for x in c:
                n[at[x]] += per[i]
        used = {x[s:e] for x in flat for s in range(len(x)) for e in range(s + 1, len(x) + 1)}
        index = {p: i for i, p in enumerate(sorted(used.intersection(pieces)))}
        lattice = Lattice(flat, index, max(map(len, index), default=1))
        theta = np.full((len(index) + 1, len(languages)), 1.0 / (len(index) + 1))
        for _ in range(rounds):
            uses = lattice.expected(theta, n)
            uses[-1] = 0
            total = np.maximum(uses.sum(axis=0), 1e-9)
            # languages weigh the same in the common rate
            common = ((uses / total).mean(axis=1) + 1e-7)[:, None]
            common = common / common.sum()
            theta = common * (uses + shrink) / (common * total + shrink)
            theta = theta / theta.sum(axis=0)
            theta[-1] = UNKNOWN
        return cls(languages, index, theta)

    @staticmethod
    def cuts(word: str) -> list[str]:
        w = "▁" + word
        return [w[i : i + LONGEST] for i in range(0, len(w), LONGEST)]

    def rows(self, found: list[str]) -> np.ndarray:
        """Row numbers of words in `table`; new words are scored first. The table is dropped when it has grown too large."""
        try:
            return np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        except KeyError:
            pass
        if len(self.known) > 500_000:
            self.known, self.table = {}, self.table[:0]
        new = list({w for w in found if w not in self.known})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            cut = [self.cuts(w) for w in part]
            flat = list({x for c in cut for x in c})
            _, whole = Lattice(flat, self.index, self.longest).forward(self.theta)
            score = dict(zip(flat, np.log(np.maximum(whole, 1e-300))))
            add = np.array([sum((score[x] for x in c[1:]), score[c[0]]) for c in cut], np.float32)
            for w in part:
                self.known[w] = len(self.known)
            self.table = np.concatenate([self.table, add])
        return np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Texts x languages: log probabilities of their words, numbers left out. A text without words has zeros."""
        split = [[w for w in words(t) if not w.isdigit()] for t in texts]
        n = np.array([len(s) for s in split], np.int64)
        out = np.zeros((len(texts), len(self.languages)))
        if n.sum():
            rows = self.rows([w for s in split for w in s])
            has = np.flatnonzero(n)
            out[has] = np.add.reduceat(self.table[rows].astype(np.float64), np.r_[0, np.cumsum(n[has])[:-1]], axis=0)
        return out


def fit_on(df: DataFrame, id_col: str, text_cols: list[str], label: str, label_map: dict[str, str | None], vocabulary: tuple[str, ...] = VOCABULARY, sample: int = 1200) -> LanguageModel:
    """A model fitted on about `sample` labelled rows of each language (the bound), chosen by hash of the id."""
    known = {k: v for k, v in label_map.items() if v}
    of = F.col(f"`{label}`")
    rows = df.filter(of.isin(*known)) if known else df.limit(0)
    count: Counter = Counter()
    for r in rows.groupBy(of.alias("label")).count().collect():
        count[known[r[0]]] += r[1]
    roll = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string")), F.lit(1_000_000))
    chosen = F.lit(False)
    for k, n in sorted(count.items()):
        chosen = chosen | (of.isin(*[x for x in known if known[x] == k]) & (roll < int(min(1.0, sample / n) * 1_000_000)))
    data = rows.filter(chosen).limit(2 * sample * max(1, len(count))).select(of.alias("label"), *[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(text_cols)]).collect()
    segments = [(known[r[0]], s) for r in data for t in r[1:] for s in lines(t)]
    pieces = read_pieces(vocabulary)

    def counted(of: list[tuple[str, str]]) -> dict[str, Counter]:
        out: dict[str, Counter] = {k: Counter() for k in set(known.values())}
        for k, s in of:
            out[k].update(w for w in words(s) if not w.isdigit())
        return out

    model = LanguageModel.fit(counted(segments), pieces)
    if not model.languages:
        return model
    best = model.scores([s for _, s in segments]).argmax(axis=1)
    agree = [x for x, b in zip(segments, best) if model.languages[b] == x[0]]
    return LanguageModel.fit(counted(agree), pieces)


def identify(df: DataFrame, id_col: str, model: LanguageModel, title: str, body: str, label: str | None = None, margin: float = 8.0) -> DataFrame:
    """(id, seg_kind, line_no, n_chars, lang, confidence, main_lang, label) of each record, title and line.

    label is the record's declared one, on its own row only (null elsewhere, and if no label column is named).

    A segment has the language of its highest score, but that of its record unless it is better by `margin` nats. The
    record's language is that of most characters of its lines; without lines, its title's. A record without title and
    lines, and everything if the model knows no language, has a null language and confidence 0. Blank titles have no row.
    Confidence is the posterior at even odds, for a record the share of characters in its language. No shuffle.
    """
    names = model.languages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, own, no = [], [], []
            for i, (t, d) in enumerate(zip(b["title"], b["body"])):
                if t and t.strip():
                    texts.append(t.strip())
                    own.append(i)
                    no.append(0)
                ls = lines(d)
                texts += ls
                own += [i] * len(ls)
                no += range(1, len(ls) + 1)
            own, no, n = np.array(own, np.int64), np.array(no, np.int32), len(b)
            chars = np.array([len(t) for t in texts], np.int64)
            main, share = np.full(n, -1), np.zeros(n)
            if names and len(texts):
                s = model.scores(texts)
                best, at = s.argmax(axis=1), np.arange(len(s))
                has_lines = np.zeros(n, bool)
                has_lines[own[no > 0]] = True
                votes = (no > 0) | ~has_lines[own]

                def majority(lang):
                    w = np.zeros((n, len(names)))
                    np.add.at(w, (own[votes], lang[votes]), chars[votes])
                    total = w.sum(axis=1)
                    return np.where(total > 0, w.argmax(axis=1), -1), w.max(axis=1) / np.maximum(total, 1)

                main, share = majority(best)
                for _ in range(2):
                    m = main[own]
                    lang = np.where(s[at, best] - s[at, m] > margin, best, m)
                    main, share = majority(lang)
                m = main[own]
                lang = np.where(s[at, best] - s[at, m] > margin, best, m)
                p = np.exp(s - s.max(axis=1, keepdims=True))
                conf = (p / p.sum(axis=1, keepdims=True))[at, lang]
            else:
                lang, conf = np.full(len(texts), -1), np.zeros(len(texts))
            ids = b["id"].to_numpy()
            yield pd.DataFrame({"id": ids, "seg_kind": "record", "line_no": np.zeros(n, np.int32), "n_chars": np.bincount(own, chars, n).astype(np.int64) if len(own) else np.zeros(n, np.int64), "lang": main, "confidence": share, "main_lang": main, "label": b["label"]})
            if len(own):
                yield pd.DataFrame({"id": ids[own], "seg_kind": np.where(no > 0, "line", "title"), "line_no": no, "n_chars": chars, "lang": lang, "confidence": conf, "main_lang": main[own], "label": None})

    named = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    out = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{title}`").alias("title"), F.col(f"`{body}`").alias("body"), (F.col(f"`{label}`") if label else F.lit(None)).cast("string").alias("label"))
    out = out.mapInPandas(run, f"id {df.schema[id_col].dataType.simpleString()}, seg_kind string, line_no int, n_chars bigint, lang int, confidence double, main_lang int, label string")
    return out.withColumns({c: F.when(F.col(c) >= 0, F.get(named, F.col(c))) for c in ("lang", "main_lang")}).withColumnRenamed("id", id_col)


def contradictions(segments: DataFrame, id_col: str, label_map: dict[str, str | None], least: int = 40) -> DataFrame:
    """(id, seg_kind, line_no, lang): records whose label is missing, unknown or wrong, and titles and lines in another
    language than the main one (lines of at least `least` characters, titles of records with lines). segments: of identify
    with a label."""
    known = F.create_map(*[F.lit(x) for kv in label_map.items() if kv[1] for x in kv]) if any(label_map.values()) else F.create_map().cast("map<string,string>")
    stands = F.coalesce(F.element_at(known, F.coalesce(F.col("label"), F.lit(""))), F.lit(""))
    long = F.col("n_chars") >= F.when(F.col("seg_kind") == "line", least).otherwise(0)
    case = F.when(F.col("seg_kind") == "record", stands != F.col("lang")).otherwise(long & (F.col("lang") != F.col("main_lang")))
    return segments.filter("lang is not null").filter(case).select(id_col, "seg_kind", "line_no", "lang")
