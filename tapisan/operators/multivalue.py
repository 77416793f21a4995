r"""Fields that pack several values: a parsing expression grammar with ordered alternatives.

    field     <- ws bracketed ws END / list END
    bracketed <- '[' item (sep item)* ']'
    list      <- item (sep item)*
    item      <- ws (quoted / known / bare / empty) ws
    quoted    <- '"' ('""' / '\' any / !'"' any)* '"' &(ws (sep / END))     and the same with ' or typographic quotes
    known     <- the longest known name, &(ws (sep / END))
    bare      <- ('\' any / !sep any)+
    sep       <- [,;|/•·、\n\t] / ' - ' / ' > '

Alternatives are tried in order; one that fails gives its input back. A quote that never closes, or closes before
something that is no separator, makes `quoted` fail, so the text is read again as `bare` and flagged `quote`; an
unclosed bracket is flagged `bracket`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEP = re.compile(r"[,;|/•·、\n\t]|(?<=\s)[->](?=\s)|(?<=\s)[->]$|^[->](?=\s)")
WS = re.compile(r"\s*")
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»"}


class PackedGrammar:
    """parse(text) gives (value, form, flag) in order; form is quoted, known or bare."""

    def __init__(self, known: Iterable[str] = ()):
        names = sorted({" ".join(n.split()) for n in known if n and n.strip()}, key=lambda n: (-len(n), n))
        self.known = re.compile("|".join(r"\s+".join(map(re.escape, n.split())) for n in names), re.IGNORECASE) if names else None

    def ends(self, text: str, at: int, end: int) -> bool:
        at = WS.match(text, at, end).end()
        return at >= end or bool(self.sep(text, at, end)) or text[at - 1 : at] in ("\n", "\t")

    @staticmethod
    def sep(text: str, at: int, end: int) -> re.Match | None:
        return SEP.match(text, at, end)

    def quoted(self, text: str, at: int, end: int) -> tuple[str, int] | None:
        close = QUOTES.get(text[at])
        if close is None:
            return None
        out, i = [], at + 1
        while i < end:
            c = text[i]
            if c == "\\" and i + 1 < end:
                out.append(text[i + 1])
                i += 2
            elif c == close:
                if text[i + 1 : i + 2] == close and i + 1 < end:
                    out.append(c)
                    i += 2
                elif self.ends(text, i + 1, end):
                    return "".join(out), i + 1
                elif close == '"':
                    return None
                else:  # an apostrophe inside the value
                    out.append(c)
                    i += 1
            else:
                out.append(c)
                i += 1
        return None

    def bare(self, text: str, at: int, end: int) -> tuple[str, int]:
        out, i = [], at
        while i < end and not self.sep(text, i, end):
            if text[i] == "\\" and i + 1 < end:
                i += 1
            out.append(text[i])
            i += 1
        return "".join(out), i

    def items(self, text: str, at: int, end: int) -> list[tuple[str, str, str | None]]:
        out: list[tuple[str, str, str | None]] = []
        while at <= end:
            # blanks before an item, but not the line feeds and tabs that separate
            while at < end and text[at].isspace() and text[at] not in "\n\t":
                at += 1
            if at < end:
                flag = None
                if hit := self.quoted(text, at, end):
                    value, at, form = *hit, "quoted"
                elif self.known and (m := self.known.match(text, at, end)) and self.ends(text, m.end(), end):
                    value, at, form = m.group(), m.end(), "known"
                else:
                    flag = "quote" if text[at] in '"“«' else None
                    value, at = self.bare(text, at, end)
                    form = "bare"
                if (value := value.strip()) and value != "-":
                    out.append((value, form, flag))
            while at < end and text[at].isspace() and not self.sep(text, at, end):
                at += 1
            if at >= end:
                break
            m = self.sep(text, at, end)
            at = m.end() if m else at + 1
        return out

    def parse(self, text: str | None) -> list[tuple[str, str, str | None]]:
        if text is None or not text.strip() or text.strip() == "-":
            return []
        s, e = len(text) - len(text.lstrip()), len(text.rstrip())
        flag = None
        if text[s] == "[":
            if text[e - 1] == "]" and e - s > 1:
                return self.items(text, s + 1, e - 1)
            flag = "bracket"
        elif self.known and (m := self.known.fullmatch(text, s, e)):
            return [(m.group(), "known", None)]
        return [(v, f, x or flag) for v, f, x in self.items(text, 0, len(text))]


def split_packed(df: DataFrame, column: str, keys: list[str], known: Iterable[str] = (), pos: str = "pos", value: str = "value") -> DataFrame:
    """One row for each value: keys, pos (from 1), value, form, flag, n_values.

    Null, blank and '-' fields give no rows; repeated values count each time; an empty table gives an empty result; columns
    that are neither key nor field are not read, so their names can't clash. `known` is a fixed list of names (shipped with
    the function). Rows stay where they are: no shuffle.
    """
    grammar = PackedGrammar(known)
    inner = [f"k{i}" for i in range(len(keys))]
    source = df.select(*[F.col(f"`{k}`").alias(i) for k, i in zip(keys, inner)], F.col(f"`{column}`").alias("t")).filter(F.trim("t") != "")
    schema = T.StructType([T.StructField(i, source.schema[i].dataType) for i in inner] + [T.StructField("p", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("form", T.StringType()), T.StructField("flag", T.StringType()), T.StructField("n_values", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list] = {}
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b["t"].tolist()):
                got = seen.get(t)
                if got is None:
                    if len(seen) > 50_000:
                        seen.clear()
                    got = seen[t] = grammar.parse(t)
                n = len(got)
                for p, (v, f, x) in enumerate(got, 1):
                    at.append(i)
                    rows.append((p, v, f, x, n))
            out = b[inner].take(at).reset_index(drop=True)
            out[["p", "v", "form", "flag", "n_values"]] = pd.DataFrame(rows, columns=["p", "v", "form", "flag", "n_values"])
            yield out

    return source.mapInPandas(run, schema).select(*[F.col(i).alias(k) for i, k in zip(inner, keys)], F.col("p").alias(pos), F.col("v").alias(value), "form", "flag", "n_values")
