"""Words, lines, shingles and hashes shared by the operators on texts."""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that Python counts as \w without being a letter or a decimal digit.
_OTHER = {c: " " for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and unicodedata.category(c) not in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd")}
_OTHER_TO_BLANK = str.maketrans(_OTHER)
_WORDS = re.compile(r"[^\W_]+")
_ASCII = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
#: White space in the wide sense: Unicode's, with carriage returns, no-break spaces and the byte order mark's relatives left alone.
SPACE = " \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"


def words(text: str | None) -> list[str]:
    """Runs of letters and decimal digits of the lower-cased text; every other character separates."""
    if not text:
        return []
    text = text.lower()
    if text.isascii():
        return text.encode().translate(_ASCII).decode().split()
    if not _OTHER.keys().isdisjoint(text):
        text = text.translate(_OTHER_TO_BLANK)
    return _WORDS.findall(text)


def lines(text: str | None) -> list[str]:
    """Lines as numbered from 1: cut at line feeds, stripped of white space, blank ones dropped."""
    return [x for x in (y.strip(SPACE) for y in text.split("\n")) if x] if text else []


def lines_col(text: Column) -> Column:
    """The same as a column: array<string>."""
    cut = F.split(F.regexp_replace(text, f"[{SPACE}]*\n[{SPACE}]*", "\n"), "\n")
    return F.filter(F.transform(cut, lambda x: F.trim(x, F.lit(SPACE))), lambda x: x != "")


def site_col(url: Column) -> Column:
    """Host in lower case without a leading www. or m.; null where there is none."""
    host = F.lower(F.regexp_extract(F.trim(url, F.lit(SPACE)), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.lit(""))


class WordHashes:
    """64-bit hashes of words; the cache is dropped when it has grown to `most` words."""

    def __init__(self, most: int = 400_000):
        self.cache: dict[str, int] = {}
        self.most = most

    def __call__(self, found: list[str]) -> np.ndarray:
        cache = self.cache
        try:
            return np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
        except KeyError:
            if len(cache) > self.most:
                cache.clear()
            for w in found:
                if w not in cache:
                    cache[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` successive words; empty if the text is shorter."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return np.unique(mixed(out))


class MinHash:
    """k minimum hashes of a set of 64-bit hashes, as uint32."""

    def __init__(self, k: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.a = (r.integers(0, 2**32, k, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.b = r.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = (x >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.a), 2**32 - 1, np.uint32)
        for at in range(0, len(x), 512):
            np.minimum(best, (x[at : at + 512, None] * self.a + self.b).min(axis=0), out=best)
        return best


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted distinct arrays; 0 if both are empty."""
    if not len(a) and not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
