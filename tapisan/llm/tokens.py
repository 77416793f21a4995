"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE for many languages.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The public pattern by which byte-level BPE cuts texts before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Counter:
    """Counts tokens; special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> int:
        return len(self.encoding.encode_ordinary(text)) if text else 0


def token_counts(df: DataFrame, id_col: str, text_col: str, keep: list[str] = (), path: str = RANKS) -> DataFrame:
    """(id, tokens, keep...): tokens of every row's whole text, 0 for null and empty ones. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = Counter(path)
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "_tokens": [count(t) for t in b["_text"]], **{f"_k{i}": b[f"_k{i}"] for i in range(len(keep))}})

    kept = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    base = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), *kept)
    schema = f"_id {base.schema['_id'].dataType.simpleString()}, _tokens bigint" + "".join(f", _k{i} {base.schema[f'_k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    return base.mapInPandas(run, schema).select(F.col("_id").alias(id_col), F.col("_tokens").alias("tokens"), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])
