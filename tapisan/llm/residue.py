"""Template residue, filler, error pages and demands for scripts.

An unfilled placeholder anywhere makes a document residue; that is a grammar over whole texts. Messages and filler are found
by their near-duplicates. A text is a list of pieces (sentences, with numbers and ids masked). A few trusted rules, about one
wording of each kind of message and language, label pieces for sure. SimHash fingerprints over the pieces' character runs are
stored in partitioned tables (two of eight blocks equal), matches are verified by Hamming distance and by the similarity of
the runs, and labels run along the links until every component that holds a trusted piece is labelled; components without
one are never walked. A document of which a third is labelled gives its label to its other pieces, which link on in turn. A
document is residue if all its pieces are labelled, so a real text that quotes a message is none.

Every piece of every document enters the tables. The labelled side of a round goes to the tasks as arrays in parts of a
fixed size, so the tables are neither shuffled nor broadcast and the driver holds one part at a time.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapisan.config import written
from tapisan.llm.text import SPACE, mixed, words

_INNER = r"[^\W_](?:[^{}<>\[\]%@~\n]{0,38}[^\W_])?"
PLACEHOLDER = re.compile(
    rf"\{{\{{\s*{_INNER}\s*\}}\}}|\{{%\s*{_INNER}\s*%\}}|<%=?\s*{_INNER}\s*%>|[$#]\{{\s*{_INNER}\s*\}}|(?<![{{$#])\{{{_INNER}\}}(?!\}})|\[\[\s*{_INNER}\s*\]\]"
    rf"|<<\s*{_INNER}\s*>>|&lt;\s*{_INNER}\s*&gt;|@@\s*{_INNER}\s*@@|(?<!\w)__\s*{_INNER}\s*__(?!\w)|(?<![\w%])%(?=[^\W\d])[^\W](?:[^%\n]{{0,38}}[^\W_])?%(?![\w%])|(?<![\w~])~(?=[^\W\d]){_INNER}~(?![\w~])"
)
#: In single square or angle brackets only what looks like a field's name is a placeholder.
BRACKETED = re.compile(
    r"[\[<](?:[A-Z][A-Z0-9]*(?:[_ -][A-Z0-9]+)+|[^\W\d_]+(?:[_.][^\W_]+)+|(?:nama|isi|judul|tajuk|tulis|masukkan|insert|inserte|your|body|title|texto|nombre|autor|author|name|date|fecha|tanggal|tarikh|penulis|publish)(?:[ _.-][^\[\]<>\n]{1,38})?)[\]>]",
    re.IGNORECASE,
)
TAGS = re.compile(r"</?(?:html|head|title|body|h[1-6]|p|div|span|noscript|br|hr|center|b|i|a|ul|li|script|meta|pre|code|em|strong|table|tr|td)\b[^<>]*>", re.IGNORECASE)
#: A text that tells to fill a placeholder writes about it.
ABOUT = re.compile(r"\b(?:replac\w*|substitut\w*|mengganti\w*|diganti\w*|ganti\w*|menukar\w*|tukar\w*|cambi\w*|reemplaz\w*|sustitu\w*|reempla[cz]\w*|placeholder\w*|variables?)\b", re.IGNORECASE)

#: Trusted wordings of masked pieces, about one of each kind of message in each language; the rest is left to propagation.
MESSAGE = re.compile(
    r"""
    ^(?:(?:http|error|galat|ralat|kode|kod|c[oó]digo|code|status)\ )?0\W+(?:\w+\ ){0,2}(?:not\ found|unavailable|tidak\ ditemukan|tidak\ tersedia|tidak\ dijumpai|sudah\ tiada|sudah\ tidak\ ada|no\ longer\ exists|no\ encontrad[oa]|no\ disponible|forbidden|bad\ gateway)$
    | \b(?:our|kami|nuestro)\ .*\b(?:code|kode|kod|c[oó]digo)\ 0$
    | ^(?:access|request|akses|permintaan|acceso|solicitud)\ (?:denied|blocked|ditolak|diblokir|disekat|denegad[oa]|bloquead[oa])$
    | ^(?:too\ many\ requests|rate\ limit|terlalu\ banyak\ permintaan|permintaan\ terlalu\ banyak|demasiadas\ (?:solicitudes|peticiones))\b
    | ^(?:your\ session|sesi\ anda|su\ sesi[oó]n)\ .*\b(?:sign|log|login|masuk|entre|inicie)\b
    | ^(?:site|this\ (?:site|service)|situs|layanan|laman|perkhidmatan|este\ (?:servicio|sitio))\ .*\b(?:maintenance|pemeliharaan|penyelenggaraan|diselenggara|mantenimiento)$
    | ^(?:sorry|maaf|mohon\ maaf|lo\ sentimos)\W+.*\b(?:page|halaman|laman|p[aá]gina)\b.*\b(?:found|removed|moved|dihapus|dipindahkan|dialih|ditemukan|dijumpai|borrada|eliminada|existe)$
    | \b(?:connection|koneksi|sambungan|conexi[oó]n)\b.*\b(?:before|sebelum|antes\ de)\b
    | ^(?:please\ )?(?:enable|activate|aktifkan|sila\ aktifkan|active|habilite)\ .*\b(?:javascript|scripts?|skrip)\b.*\b(?:browser|peramban|pelayar|navegador)\b
    | ^(?:this|situs|aplikasi|laman|est[ea])\ .*\b(?:without|tanpa|sin)\ (?:javascript|script\w*|skrip|secuencias\ de\ comandos)$
    | ^(?:confirm|pastikan|sahkan|confirme)\ .*\b(?:you\ are\ not\ a\ robot|anda\ bukan\ robot|que\ no\ es\ un\ robot)\b
    | ^(?:your\ browser|peramban\ anda|pelayar\ anda|su\ navegador)\ .*\b(?:scripts?|skrip|secuencias\ de\ comandos)$
    """,
    re.VERBOSE,
)
FILLER = re.compile(
    r"""
    \b(?:placeholder|dummy|filler)\ (?:text|copy|content)\b | \bteks\ (?:pengganti|sementara|isian)\b | \btexto\ (?:de\ relleno|provisional|de\ ejemplo)\b
    | \b(?:sample|test)\ text\ (?:sample|test)\ text\b | \bcontoh\ teks\ contoh\ teks\b | \bteks\ uji(?:an)?\ teks\ uji(?:an)?\b | \bprueba\ de\ texto\ prueba\ de\ texto\b
    | \b(?:title|headline)\ (?:goes\ )?here\b.*\bhere\b | \b(?:judul|tajuk)\ di\ sini\b.*\bdi\ sini\b | \bt[ií]tulo\ (?:va\ )?aqu[ií]\b.*\baqu[ií]\b
    | \b(?:to|will)\ be\ (?:added|filled\ in)\ (?:later|soon)\b | \bakan\ (?:ditambahkan|diisi|dimasukkan)\ (?:nanti|menyusul|kemudian)\b | \bse\ (?:agregar[aá]|completar[aá])\ (?:luego|pronto|despu[eé]s)\b
    """,
    re.VERBOSE,
)
LATIN = r"(?i)\b(?:lorem|ipsum)\b"
#: Common words of real texts; filler in mock Latin has none.
REAL = frozenset("the of and to for with that is are yang dan untuk pada dari dengan tidak bagi serta kepada dalam atau akan juga bisa boleh de la el los las que para con una por en se no como".split())
CHROME = re.compile(r"^(?:©.*|\W*|[\w.-]+/\d+(?:\.\d+)+|(?:ref|ray|id|incident|trace)\W*[0-9a-f]{6,}\W*)$", re.IGNORECASE)
NAME_LINE = re.compile(r"^(?:[^\W\d_a-zà-ÿ][^\W_]*)(?: [^\W\d_a-zà-ÿ][^\W_]*){0,2}$")
ZERO = re.compile(r"[​-‏⁠﻿­]")
SENTENCE, IDS, NUMBERS = re.compile(r"(?<=[.!?;])\s+"), re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{7,}\b"), re.compile(r"\d+")
#: Characters of a run, least similarity of two pieces' runs, Hamming distance of their 128 bits, and share of a document that labels the rest of it.
RUN, SIMILAR, BITS, SHARE = 4, 0.6, 40, 0.34
#: Labelled pieces that a pass holds as arrays (24 bytes each), most keys of 8 bytes that are broadcast (more are shuffled), and pieces whose fingerprints are counted at once.
PART, BROADCAST_KEYS, CHUNK = 100_000, 100_000, 4096
#: What a trusted wording that needn't begin its piece can't do without; others are tried at the beginning only.
FILLER_HINTS = ("placeholder ", "dummy ", "filler ", "teks ", "texto ", " text ", "here", "di sini", "aqu", "be added", "be filled", "akan di", "se agregar", "se completar")
MESSAGE_HINTS = ("connection", "koneksi", "sambungan", "conexi", "enable", "activate", "aktif", "active", "habilite")
#: Words of mock Latin's vocabulary that are kept.
LATIN_WORDS = 5000


def unwrapped(text: str) -> str:
    """The text without tags, or the message of a JSON error body; invisible characters dropped."""
    text = ZERO.sub("", text).replace("\xa0", " ")
    t = text.strip(SPACE)
    if t[:1] == "{" and t[-1:] == "}":
        try:
            value = json.loads(t, strict=False)
            if isinstance(value, dict) and value and all(isinstance(v, (str, int, float, type(None))) for v in value.values()):
                return "\n".join(v for k, v in value.items() if isinstance(v, str) and k.lower() not in ("trace", "id", "request_id", "path", "timestamp"))
        except ValueError:
            pass
    return TAGS.sub("\n", text) if "<" in text else text


def has_placeholder(text: str) -> bool:
    """An unfilled placeholder anywhere, except in a sentence that tells to replace it."""
    if not any(c in text for c in "{[<%@_~&"):
        return False
    text = TAGS.sub("\n", text)
    for pattern in (PLACEHOLDER, BRACKETED):
        for m in pattern.finditer(text):
            start = max(text.rfind("\n", 0, m.start()), text.rfind(". ", 0, m.start())) + 1
            ends = [e for e in (text.find("\n", m.end()), text.find(". ", m.end())) if e >= 0]
            if not ABOUT.search(text[start : m.start()] + " " + text[m.end() : min(ends, default=len(text))]):
                return True
    return False


def masked(sentence: str) -> str:
    """Lower case, runs of digits as 0, long hexadecimal ids as x, no outer punctuation."""
    return NUMBERS.sub("0", IDS.sub("x", sentence.lower())).strip(" .!?;,…")


def line_pieces(line: str) -> list[str]:
    line = " ".join(line.split())
    if not line or CHROME.match(line) or NAME_LINE.match(line):
        return []
    return [p for p in map(masked, SENTENCE.split(line)) if p]


def pieces(text: str | None) -> list[str]:
    """The masked sentences of all lines but bare names, copyright lines and ids; empty for null and blank texts."""
    return [p for x in unwrapped(text).split("\n") for p in line_pieces(x)] if text else []


def trusted(piece: str, latin: frozenset[str] = frozenset()) -> str | None:
    """message, filler or None of a masked piece; `latin` is the vocabulary of mock Latin."""
    if any(x in piece for x in FILLER_HINTS) and FILLER.search(piece):
        return "filler"
    if MESSAGE.match(piece) or ((piece.endswith(" 0") or any(x in piece for x in MESSAGE_HINTS)) and MESSAGE.search(piece)):
        return "message"
    if latin:
        own = words(piece)
        if len(own) >= 2 and sum(w in latin for w in own) >= 0.8 * len(own):
            return "filler"
    return None


def latin_words(df: DataFrame, id_col: str, text_col: str, most: int = LATIN_WORDS) -> frozenset[str]:
    """The vocabulary of mock Latin: words of pieces without any common word, in all documents that hold one of its known words.

    A word counts if it occurs in at least two such documents, or if there is but one; the `most` frequent are kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [{w for p in pieces(t) if not REAL.intersection(ws := words(p)) for w in ws if not w.isdigit()} for t in b["text"]]
            yield pd.DataFrame({"w": [w for ws in own for w in (*ws, *([""] if ws else []))]}, dtype=object)

    has = df.select(F.col(f"`{text_col}`").alias("text")).filter(F.col("text").rlike(LATIN))
    count = has.mapInPandas(run, "w string").groupBy("w").agg(F.count("*").alias("n"))
    found = {r[0]: r[1] for r in count.orderBy(F.desc("n"), "w").limit(most + 1).collect()}
    docs = found.pop("", 0)  # every document counts once for the empty word, so that comes first
    return frozenset(w for w, n in found.items() if n >= min(2, docs))


def runs(piece: str) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the piece's runs of RUN characters, outer blanks included."""
    t = f" {piece} "
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(t[i : i + RUN]) for i in range(max(1, len(t) - RUN + 1))), np.uint32))


def run_hashes(text: str) -> np.ndarray:
    """The 32-bit hashes of `runs` of all runs of RUN = 4 characters of the text, by place."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    # xxh32 of four bytes
    h = (chars[:-3] | chars[1:-2] << 8 | chars[2:-1] << 16 | chars[3:] << 24) * np.uint32(3266489917) + np.uint32(374761393 + 4)
    h = (h << 17 | h >> 15) * np.uint32(668265263)
    h = (h ^ h >> 15) * np.uint32(2246822519)
    h = (h ^ h >> 13) * np.uint32(3266489917)
    h ^= h >> 16
    wide = chars > 127
    if wide.any():
        for i in np.flatnonzero(wide[:-3] | wide[1:-2] | wide[2:-1] | wide[3:]):
            h[i] = xxhash.xxh32_intdigest(text[i : i + RUN])
    return h.astype(np.uint64)


def simhashes(own: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent fingerprints of 64 bits of each piece, each bit the majority of that bit over its runs, and the number of its runs.

    Bits are counted in planes: plane k holds bit k of the counts of all 64 places of a word, and a run is added to all at once.
    """
    sizes = np.array([max(1, len(p) + 3 - RUN) for p in own], np.int64)
    out, order = np.zeros((len(own), 2), np.int64), np.argsort(-sizes, kind="stable")
    for at in range(0, len(own), CHUNK):
        some = order[at : at + CHUNK]
        texts = [f" {own[i]} ".ljust(RUN) for i in some]
        text = "".join(texts)
        lengths = np.array(list(map(len, texts)))
        starts, n = np.r_[0, np.cumsum(lengths)[:-1]], lengths - RUN + 1
        h = run_hashes(text)
        h = np.stack([mixed(h), mixed(h + np.uint64(2**32))], axis=1)
        planes = np.zeros((int(n[0]).bit_length(), len(some), 2), np.uint64)
        for place, m in zip(range(int(n[0])), len(n) - np.searchsorted(n[::-1], np.arange(int(n[0])), side="right")):
            carry = h[starts[:m] + place]
            for k in range((place + 1).bit_length()):
                plane = planes[k, :m]
                both = plane & carry
                plane ^= carry
                carry = both
        # places whose count is more than half
        half, more, same = (n // 2)[:, None], np.zeros((len(some), 2), np.uint64), np.full((len(some), 2), 2**64 - 1, np.uint64)
        for k in reversed(range(len(planes))):
            bit = np.where(half >> k & 1, np.uint64(2**64 - 1), np.uint64(0))
            more |= same & planes[k] & ~bit
            same &= ~(planes[k] ^ bit)
        out[some] = more.view(np.int64)
    return out, sizes


def marked(df: DataFrame, id_col: str, text_col: str, latin: frozenset[str]) -> DataFrame:
    """A row for each piece of every document; documents with a placeholder have one row without a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number: dict[str, int] = {}
            ids, at, gaps = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t or not t.strip(SPACE):
                    continue
                if has_placeholder(t):
                    gaps.append(i)
                    continue
                own = [number.setdefault(p, len(number)) for p in pieces(t)]
                ids += [i] * len(own)
                at += own
            own, at = list(number), np.array(at, np.int64)
            prints, n = simhashes(own)
            h = np.array([xxhash.xxh3_64_intdigest(p) - 2**63 for p in own], np.int64)
            chars = np.array(list(map(len, own)), np.int32)
            kinds = pa.array([trusted(p, latin) for p in own], pa.string())
            cols = [pa.array(ids, pa.int64()), *(pa.array(x[at]) for x in (h, prints[:, 0], prints[:, 1], n.astype(np.int32), chars)), kinds.take(pa.array(at)), pa.array(own, pa.string()).take(pa.array(at))]
            yield pa.RecordBatch.from_arrays(cols, names=PIECE_NAMES)
            if gaps:
                yield pa.RecordBatch.from_arrays([pa.array(gaps, pa.int64()), *(pa.nulls(len(gaps), c.type) for c in cols[1:])], names=PIECE_NAMES)

    base = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("id is not null")
    return base.mapInArrow(run, PIECES)


PIECES = "id bigint, h bigint, s0 bigint, s1 bigint, n int, chars int, rule string, piece string"
PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]
NODE = ["h", "s0", "s1", "n"]


def small(df: DataFrame, n: int, most: int = BROADCAST_KEYS) -> DataFrame:
    """df of n rows, broadcast if these are at most `most`."""
    return F.broadcast(df) if n <= most else df


class Tables:
    """Labelled pieces in partitioned tables: one for each two of the eight blocks of each of the two SimHashes, both equal in a candidate."""

    def __init__(self, h: np.ndarray, s0: np.ndarray, s1: np.ndarray):
        self.h, self.s = h, (s0.view(np.uint64), s1.view(np.uint64))
        self.order, self.starts = [], []
        for key in self.keys(s0, s1):
            self.order.append(np.argsort(key, kind="stable").astype(np.int32))
            self.starts.append(np.r_[0, np.cumsum(np.bincount(key, minlength=65536))].astype(np.int32))
        self.used = [np.diff(x) > 0 for x in self.starts]

    @staticmethod
    def keys(s0: np.ndarray, s1: np.ndarray) -> Iterator[np.ndarray]:
        for s in (s0, s1):
            b = np.ascontiguousarray(np.ascontiguousarray(s).view(np.uint8).reshape(-1, 8).T).astype(np.uint16)
            for i, j in itertools.combinations(range(8), 2):
                yield b[i] << 8 | b[j]

    def near(self, h: np.ndarray, s0: np.ndarray, s1: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the given pieces and of the labelled ones that they may be near to."""
        found = [np.zeros(0, np.int64)]
        a, b = s0.view(np.uint64), s1.view(np.uint64)  # counts of signed numbers would be those of their amounts
        for key, used, order, starts in zip(self.keys(s0, s1), self.used, self.order, self.starts):
            own = np.flatnonzero(used[key])
            low = starts[key[own]]
            many = starts[key[own].astype(np.int64) + 1] - low
            for cut in np.split(np.arange(len(own)), np.flatnonzero(np.diff(np.cumsum(many) // 1_000_000)) + 1):
                if len(cut):
                    m = many[cut]
                    x = np.repeat(own[cut], m)
                    y = order[np.repeat(low[cut] - (np.cumsum(m) - m), m) + np.arange(len(x))]
                    ok = np.bitwise_count(a[x] ^ self.s[0][y]).astype(np.int16) + np.bitwise_count(b[x] ^ self.s[1][y]) <= bits
                    x, y = x[ok], y[ok]
                    ok = h[x] != self.h[y]
                    found.append(x[ok] * len(self.h) + y[ok])
        both = np.unique(np.concatenate(found))
        return both // max(1, len(self.h)), both % max(1, len(self.h))


def candidates(nodes: DataFrame, fresh: DataFrame, n_fresh: int, bits: int) -> DataFrame:
    """(h, s0, s1, n, a): pieces and the fresh labelled ones a that share a table key and lie within the Hamming distance.

    The fresh ones are taken in parts of about PART, one pass over the pieces for each.
    """
    parts = -(-n_fresh // PART)

    def passed(k: int) -> DataFrame:
        part = fresh.filter(F.pmod("h", F.lit(parts)) == k).select(*NODE).toArrow()
        own = [part.column(c).to_numpy() for c in NODE]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = None
            for b in batches:
                tables = tables or Tables(*own[:3])
                cols = [b.column(k).to_numpy() for k in range(4)]
                _, first = np.unique(cols[0], return_index=True)
                cols = [c[first] for c in cols]
                x, y = tables.near(*cols[:3], bits)
                yield pa.RecordBatch.from_arrays([*(pa.array(c[x]) for c in cols), pa.array(tables.h[y])], names=[*NODE, "a"])

        return nodes.select(*NODE).filter("h is not null").mapInArrow(run, "h bigint, s0 bigint, s1 bigint, n int, a bigint")

    out = [written(passed(k), "met") for k in range(parts)]
    return out[0] if parts == 1 else written(functools.reduce(DataFrame.unionByName, out), "met")


def linked(nodes: DataFrame, labels: DataFrame, fresh: DataFrame, n_labels: int, n_fresh: int, threshold: float, bits: int) -> DataFrame:
    """(h, s0, s1, n, kind): unlabelled pieces with a near-duplicate among the `fresh` of the labels (h, kind).

    Candidates share a table key; the Hamming distance is verified, then the similarity of the runs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": b["h"], "runs": [runs(p).view(np.int32) for p in b["piece"]]})

    met = candidates(nodes, fresh, n_fresh, bits)
    met = written(met.join(small(labels.select("h"), n_labels), "h", "left_anti").dropDuplicates(["h", "a"]), "open")
    ends = written(met.select(F.explode(F.array("h", "a")).alias("h")).distinct(), "ends")
    pieces_ = nodes.select("h", "piece").join(small(ends, ends.count()), "h", "left_semi").groupBy("h").agg(F.first("piece").alias("piece"))
    sets = written(pieces_.mapInPandas(run, "h bigint, runs array<int>"), "sets")
    both = met.join(sets.select(F.col("h").alias("a"), F.col("runs").alias("ra")), "a").join(sets, "h")
    shared = F.size(F.array_intersect("ra", "runs"))
    sure = both.filter(shared >= threshold * (F.size("ra") + F.size("runs") - shared) - 1e-9).join(fresh.select(F.col("h").alias("a"), "kind"), "a")
    return written(sure.groupBy("h").agg(*[F.first(c).alias(c) for c in ("s0", "s1", "n")], F.min("kind").alias("kind")), "linked")


def residue(df: DataFrame, id_col: str, text_col: str, threshold: float = SIMILAR, bits: int = BITS, share: float = SHARE) -> DataFrame:
    """(id, kind, trusted) of the residue: placeholder, filler or message; trusted is false where a label was propagated.

    Null and blank texts, and texts of names and copyright lines only, aren't residue. Each round links the newest labels to all
    pieces and then looks at the documents they touch; rounds end when nothing more is labelled. A document that holds several
    kinds is a message. Other columns aren't read.
    """
    own = written(marked(df, id_col, text_col, latin_words(df, id_col, text_col)), "pieces")
    columns = ["id", *NODE, "chars", "rule"]
    labels = fresh = arrived = written(own.filter("rule is not null").groupBy("h").agg(*[F.first(c).alias(c) for c in ("s0", "s1", "n")], F.min("rule").alias("kind")), "labels")
    n_labels = n_fresh = n_arrived = labels.count()
    full = df.sparkSession.createDataFrame([], own.select(*columns).schema)
    n_full = 0
    while n_fresh:
        new = linked(own, labels, fresh, n_labels, n_fresh, threshold, bits)
        n_new = new.count()
        labels, n_labels, arrived, n_arrived = labels.unionByName(new), n_labels + n_new, arrived.unionByName(new), n_arrived + n_new
        # all pieces of the documents that a label touches for the first time
        touched = own.select("id", "h").join(small(arrived.select("h"), n_arrived), "h", "left_semi").select("id").distinct()
        touched = written(touched.join(small(full.select("id").distinct(), n_full), "id", "left_anti"), "touched")
        if n := touched.count():
            full = full.unionByName(written(own.select(*columns).join(small(touched, n), "id", "left_semi"), "full"))
            n_full += n
        known = full.join(small(labels.select("h", "kind"), n_labels), "h", "left")
        part = known.groupBy("id").agg(F.sum("chars").alias("_n"), F.sum(F.when(F.col("kind").isNotNull(), F.col("chars"))).alias("_m"), F.max("kind").alias("k"))
        given = written(part.filter((F.col("_m") < F.col("_n")) & (F.col("_m") >= share * F.col("_n"))).select("id", "k"), "given")
        arrived = known.filter("kind is null").drop("kind").join(small(given, given.count()), "id")
        arrived = written(arrived.groupBy("h").agg(*[F.first(c).alias(c) for c in ("s0", "s1", "n")], F.max("k").alias("kind")), "arrived")
        n_arrived = arrived.count()
        labels, n_labels = written(labels.unionByName(arrived), "labels"), n_labels + n_arrived
        fresh, n_fresh = written(new.unionByName(arrived), "newest"), n_new + n_arrived
        # a round's broadcasts stay in the driver until it collects its garbage
        df.sparkSession._jvm.System.gc()
    whole = full.join(small(labels.select("h", "kind"), n_labels), "h", "left").groupBy("id").agg(F.count_if(F.col("kind").isNull()).alias("_open"), F.max("kind").alias("kind"), F.min(F.col("rule").isNotNull()).alias("trusted"))
    found = whole.filter("_open = 0").select("id", "kind", "trusted").unionByName(own.filter("h is null").select("id", F.lit("placeholder").alias("kind"), F.lit(True).alias("trusted")))
    return found.select(F.col("id").alias(id_col), "kind", "trusted")


def without_residue(df: DataFrame, id_col: str, found: DataFrame) -> DataFrame:
    """The documents that aren't residue."""
    return df.join(found.select(F.col(id_col)), id_col, "left_anti")
