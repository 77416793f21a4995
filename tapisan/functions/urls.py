"""Address functions as Column expressions."""

from __future__ import annotations

from functools import reduce
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapisan.functions.text import utrim


def host(url: Column) -> Column:
    """Host in lower case without port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(utrim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def scheme(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(utrim(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)), F.lit(""))


def store_key(c: Column) -> Column:
    """Key under which the store holds an address: lower case, trimmed, without trailing slashes."""
    return F.regexp_replace(F.lower(utrim(c)), "/+$", "")


def dedup_key(c: Column) -> Column:
    """Key of the duplicate check: lower case, trimmed; slashes count."""
    return F.lower(utrim(c))


def without_query(c: Column, keep_fragment: bool = False) -> Column:
    return F.regexp_replace(c, r"\?[^#]*" if keep_fragment else r"[?#].*$", "")


def all_pages(c: Column) -> Column:
    """The address of the article on one page."""
    return F.when(c.contains("page=all"), c).when(c.contains("?"), F.concat(c, F.lit("&page=all"))).otherwise(F.concat(c, F.lit("?page=all")))


def search_url(endpoint: str, query: Column) -> Column:
    """A search endpoint with the query escaped in place of {q}."""
    a, _, b = endpoint.partition("{q}")
    return F.concat(F.lit(a), F.url_encode(query), F.lit(b))


@F.pandas_udf(T.StringType())
def resolved(ref: pd.Series, base: pd.Series) -> pd.Series:
    """Reference resolved against a base (RFC 3986); null where that fails."""

    def one(r, b):
        try:
            return urljoin(b, r)
        except (ValueError, TypeError):
            return None

    return pd.Series([one(r, b) for r, b in zip(ref, base)], dtype=object)


def resolve(ref: Column, base: Column) -> Column:
    """Absolute and root-relative references stay in the JVM; only the others are sent to Python, as nulls else."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    plain = F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), ref).when(ref.rlike(r"^/[^/]") & ~ref.contains("./"), F.concat(root, ref))
    return F.coalesce(plain, resolved(F.when(plain.isNull(), ref), F.when(plain.isNull(), base)))


def rebased(url: Column, base: str) -> Column:
    """The address with scheme and host of another base."""
    return F.concat(F.lit(base.rstrip("/")), F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""))


def image_candidate(url: Column, denied: tuple[str, ...] = (), own_hosts: tuple[str, ...] = (), denied_own: tuple[str, ...] = ()) -> Column:
    """Whether an address may be an article's image: usable, and without a part that is denied; a site's own hosts have a list of their own."""
    low = F.lower(utrim(url))
    has = lambda parts: reduce(Column.__or__, (F.contains(low, F.lit(x)) for x in parts), F.lit(False))
    h = F.coalesce(host(url), F.lit(""))
    own = reduce(Column.__or__, (F.contains(h, F.lit(x)) for x in own_hosts), F.lit(False))
    return F.coalesce(source_error(url).isNull() & ~F.when(own, has(denied_own)).otherwise(has(denied)), F.lit(False))


def valid_host(url: Column) -> Column:
    h = F.coalesce(host(url), F.lit(""))
    return h.contains(".") & (h != "localhost")


def image_error(url: Column) -> Column:
    """null if usable ('-', a local path under gambar/, or an http(s) address with a real host), else what is wrong."""
    t = F.coalesce(utrim(url), F.lit(""))
    return F.when(t == "", "empty").when((t == "-") | t.startswith("gambar/"), None).when(scheme(t).isNull(), "malformed").when(~scheme(t).isin("http", "https"), "scheme").when(~valid_host(t), "host")


def source_error(url: Column) -> Column:
    t = F.coalesce(utrim(url), F.lit(""))
    return F.when(t == "", "empty").when(~F.lower(t).rlike("^https?://"), "scheme").when(~valid_host(t), "host")


def fixed_image(url: Column, hosts: tuple[str, ...] = ("cloudfront.net",)) -> Column:
    """'.webp' dropped after another image suffix or on content networks that serve it wrongly."""
    t = utrim(url)
    low = F.lower(t)
    wrong = low.rlike(r"\.(?:jpg|jpeg|png)\.webp$")
    for h in hosts:
        wrong = wrong | (low.endswith(".webp") & low.contains(h))
    return F.when(wrong, F.regexp_replace(t, r"\.webp$", "")).otherwise(t)


def source_name(url: Column, names: list[tuple[str, str]] = ()) -> Column:
    """A display name by the first part of the host that is listed, else the host."""
    h = F.coalesce(host(url), F.lit(""))
    out = h
    for part, name in reversed(names):
        out = F.when(h.contains(part), name).otherwise(out)
    return out
