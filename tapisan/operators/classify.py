"""Weighted keyword rules. A rule's score is the number of words of its distinct keywords found, times the field's weight;
the highest total wins, then the higher title score, then the earlier rule; without any hit the default category."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapisan.functions.text import B0, B1


class Rules:
    """Ordered rules (category, keywords); keywords of a category that differs in case only are appended to it."""

    def __init__(self, rules: list[tuple[str, list[str]]] = (), default: str = "General", title_weight: int = 3, body_weight: int = 1):
        self.rules: list[tuple[str, list[str]]] = []
        self.default, self.title_weight, self.body_weight = default, title_weight, body_weight
        for category, keywords in rules:
            self.add(category, keywords)

    def add(self, category: str, keywords: list[str]) -> None:
        category = category.strip()
        keywords = [k.strip().lower() for k in keywords if k and k.strip()]
        if not category:
            return
        for name, known in self.rules:
            if name.lower() == category.lower():
                known += [k for k in keywords if k not in known]
                return
        self.rules.append((category, list(dict.fromkeys(keywords))))

    def categories(self) -> list[str]:
        names = [n for n, _ in self.rules]
        return names if self.default.lower() in [n.lower() for n in names] else [*names, self.default]


def words_only(c: Column) -> Column:
    """Letters, digits, white space, - and ' stay; anything else is a blank."""
    return F.regexp_replace(c, r"[^\p{L}\p{Nd}\s\u0085   -     　\-']", " ")


def pattern(keyword: str) -> str:
    """Words in order, parted by blanks or hyphens, bounded by ASCII word boundaries, in any case."""
    first = B0 if re.match(r"\w", keyword) else r"(?<=[0-9A-Za-z_])"
    last = B1 if re.search(r"\w$", keyword) else r"(?=[0-9A-Za-z_])"
    return rf"(?iu){first}" + r"[\s\-]+".join(map(re.escape, keyword.split())) + last


def classify(df: DataFrame, title: str, body: str, rules: Rules, name: str = "classified") -> DataFrame:
    """df with struct(category, score, title_score, body_score, keywords) of the winner, without a join.

    Steps are projections of their own, so that no text is searched twice for a keyword; a keyword's first word is looked
    for as a plain substring before its pattern is tried.
    """
    plain = {"_t": title, "_b": body}
    out = df.withColumns({k: words_only(F.coalesce(F.col(c), F.lit(""))) for k, c in plain.items()}).withColumns({f"{k}l": F.lower(k) for k in plain})
    hits = {}
    for n, (_, keywords) in enumerate(rules.rules):
        for k in plain:
            found = [F.when(F.contains(F.col(f"{k}l"), F.lit(w.split()[0])) & F.col(k).rlike(pattern(w)), w) for w in keywords]
            hits[f"{k}{n}"] = F.array_compact(F.array(*found).cast("array<string>"))
    out = out.withColumns(hits)
    points = lambda c: F.aggregate(c, F.lit(0), lambda s, k: s + F.size(F.split(k, r"\s+")))
    out = out.withColumns({f"{k}{n}p": points(F.col(f"{k}{n}")) * w for n in range(len(rules.rules)) for k, w in (("_t", rules.title_weight), ("_b", rules.body_weight))})
    none = F.struct(F.lit(rules.default).alias("category"), F.lit(0).alias("score"), F.lit(0).alias("title_score"), F.lit(0).alias("body_score"), F.array().cast("array<string>").alias("keywords"))
    options = [F.struct((F.col(f"_t{n}p") + F.col(f"_b{n}p")).alias("score"), F.col(f"_t{n}p").alias("title_score"), F.lit(-n).alias("order"), F.lit(c).alias("category"), F.col(f"_b{n}p").alias("body_score"), F.array_union(f"_t{n}", f"_b{n}").alias("keywords")) for n, (c, _) in enumerate(rules.rules)]
    if not options:
        return df.withColumn(name, none)
    out = out.withColumn("_best", F.array_max(F.array(*options)))
    best = F.struct(*[F.col(f"_best.{c}").alias(c) for c in ("category", "score", "title_score", "body_score", "keywords")])
    return out.withColumn(name, F.when(F.col("_best.score") > 0, best).otherwise(none)).select(*df.columns, name)
