"""Text functions as Column expressions; they stay in the JVM but for texts with an ampersand, whose entities need HTML5's table."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII word boundaries: Java's own \b looks at all letters.
B0, B1 = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
BOUND = rf"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"

# Patterns that cleaning must remove for its results to agree with what is stored.
BREADCRUMB = rf"(?i){BOUND}(?:home|health topics|news|articles)\s*(?:[>/»|]\s*)+[^.\n!]+(?:[.!\n]|\z)"
NAVIGATION = rf"(?i){BOUND}(?:skip to (?:main )?content|back to top|click here to read more|read (?:full )?article|continue reading|table of contents){BOUND}[:\s\-.]*"
ADVERT = rf"(?i){BOUND}(?:advertisement|sponsored content|promoted story|advertorial){BOUND}[:\s\-.]*[^.!\n]*(?:[.!\n]|\z)"
COOKIES = rf"(?i){BOUND}(?:this website uses cookies|we use cookies to|accept (?:all )?cookies|cookie policy|manage consent|manage cookies|consent preferences)[^.!\n]*(?:[.!\n]|\z)"


def utrim(c: Column) -> Column:
    """Trimmed of all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(utrim(c), F.lit("")) == ""


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


@F.pandas_udf(T.StringType())
def entities(texts: pd.Series) -> pd.Series:
    once = texts.map(html.unescape, na_action="ignore")
    return once.map(lambda s: html.unescape(s) if "&" in s else s, na_action="ignore")


def unescape(c: Column) -> Column:
    """HTML5 entities decoded, twice where an ampersand is left. Only texts with an ampersand are sent to Python; the others are nulls there."""
    return F.coalesce(entities(F.when(F.contains(c, F.lit("&")), c)), c)


def strip_html(c: Column) -> Column:
    """Script, style and comment blocks to a blank, then tags to a blank; entities stay."""
    for block in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<!--.*?-->"):
        c = F.regexp_replace(c, block, " ")
    return F.regexp_replace(c, r"<[^>]*>", " ")


def decoded(c: Column) -> Column:
    """strip_html with entities decoded before tags are stripped, so an escaped tag is a tag."""
    for block in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<!--.*?-->"):
        c = F.regexp_replace(c, block, " ")
    return F.regexp_replace(unescape(c), r"<[^>]*>", " ")


def fix_punctuation(c: Column) -> Column:
    """Invisible characters and asterisks dropped, typographic signs to ASCII, other unprintable characters dropped."""
    c = F.translate(c, "“”„«»‘’‚—–�​‌‍﻿­*", "\"\"\"\"\"'''--")
    c = F.replace(c, F.lit("…"), F.lit("..."))
    return F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}\p{P}\p{S}\t\n\x0B\f\r \u0085   -     　]", "")


def collapse(c: Column) -> Column:
    """Runs of ASCII white space to one blank, none before .,;:!? (no-break spaces stay)."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"\s+([.,;:!?])", "$1")


def remove_residue(c: Column, cookies: bool = False) -> Column:
    for p in (BREADCRUMB, NAVIGATION, ADVERT, *((COOKIES,) if cookies else ())):
        c = F.regexp_replace(c, p, "")
    return c


def clean_title(c: Column, html_udf: bool = True) -> Column:
    return F.trim(collapse(remove_residue(fix_punctuation(decoded(c) if html_udf else strip_html(c)))), F.lit(" -|/:\t\r\n"))


def dedupe_sentences(c: Column) -> Column:
    """A text of at least 20 bytes that is a text of over 10 bytes twice gives it once; else of successive sentences that differ in case only the first stays."""

    def sentences(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, r"\. "), utrim), lambda x: x != "")
        firsts = let(parts, lambda ps: F.filter(ps, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(ps, i - 1)))))
        ended = let(F.array_join(firsts, ". "), lambda j: F.when(~j.endswith(".") & t.endswith("."), F.concat(j, F.lit("."))).otherwise(j))
        return F.when(F.contains(t, F.lit(". ")), ended).otherwise(t)

    def whole(t: Column) -> Column:
        raw = F.encode(t, "utf-8")
        k = F.floor(F.octet_length(t) / 2).cast("int")
        first, second = F.substring(raw, F.lit(1), k), F.substring(raw, k + 1, F.octet_length(t))
        # halves are compared as bytes, without the ASCII white space between them
        bare = lambda x: F.regexp_replace(F.decode(x, "iso-8859-1"), r"^\s+|\s+$", "")
        twice = let(bare(first), lambda f: (f == bare(second)) & (F.length(f) > 10))
        return F.when(F.octet_length(t) < 20, t).when(twice, utrim(F.decode(first, "utf-8"))).otherwise(sentences(t))

    return let(utrim(c), whole)


def joined(paras: Column) -> Column:
    """Paragraphs as they are, parted by blank lines."""
    return F.array_join(paras, "\n\n")


def without_initials(c: Column) -> Column:
    """Without the authors' initials in brackets at the end, such as (ab/cd) or (ab/cd/ef)."""
    return utrim(F.regexp_replace(c, r"(?i)\s*\([a-z]{2,4}/[a-z]{2,4}(?:/[a-z]{2,4})?\)\s*$", ""))


def hyphened(title: Column, slug: Column, word: str, parts: str) -> Column:
    """The word in a title written with a hyphen where the address's slug has it so."""
    return F.when(F.contains(F.lower(slug), F.lit(parts.lower())), F.regexp_replace(title, rf"(?i){B0}{word}{B1}", parts)).otherwise(title)


def encode_paragraphs(paras: Column) -> Column:
    """Stored form: trimmed, blank ones dropped, joined by a blank line."""
    return F.array_join(F.filter(F.transform(paras, utrim), lambda x: x != ""), "\n\n")


def decode_paragraphs(c: Column) -> Column:
    """Paragraphs of the stored form; null stays null."""
    return F.filter(F.transform(F.split(c, "\n\n"), utrim), lambda x: x != "")


def normal(c: Column) -> Column:
    """Lower case, letters and digits only, single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", " "))


def title_case(c: Column) -> Column:
    """First letter of each run of letters, digits, underscores and apostrophe-free words in upper case; - and ' separate."""
    parts = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), "")


def clean_category(c: Column, html_udf: bool = True) -> Column:
    clean = clean_title(c, html_udf)
    parts = F.filter(F.transform(F.split(clean, ","), utrim), lambda p: p != "")
    parts = F.transform(parts, lambda p: F.when(p == F.lower(p), title_case(p)).otherwise(p))
    return F.when(F.size(parts) > 0, F.array_join(parts, " , ")).otherwise(clean)


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / characters of the longer; two empty texts 1, one empty 0."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longer)


def truncate_sentence(c: Column, most: int = 500, least: int = 100) -> Column:
    """Texts over `most` characters are cut after the last sentence end beyond `least`, else at `most` with '...'."""
    head = F.substring(c, 1, most)
    cut = F.regexp_extract(head, rf"(?s)^(.{{{least + 1},}}[.!?])", 1)
    return F.when(F.length(c) <= most, c).when(cut != "", cut).otherwise(F.concat(head, F.lit("...")))


def strip_suffixes(c: Column, suffixes: list[str]) -> Column:
    """Site names at the end of a title removed in the given order, then what follows a pipe."""
    for s in suffixes:
        c = F.when(c.endswith(s), F.substring(c, F.lit(1), F.length(c) - len(s))).otherwise(c)
    return utrim(F.substring_index(c, "|", 1))


def distinct_folded(items: Column) -> Column:
    """Items in order, the first of each that differ in case only."""
    return F.aggregate(items, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def article_id(title: Column, url: Column) -> Column:
    """'art_' and 12 hexadecimal digits of the hash of trimmed title and address; null if both are blank."""
    t, u = F.coalesce(utrim(title), F.lit("")), F.coalesce(utrim(url), F.lit(""))
    return F.when((t != "") | (u != ""), F.concat(F.lit("art_"), F.substring(F.sha2(F.concat(t, F.lit("|"), u), 256), 1, 12)))
