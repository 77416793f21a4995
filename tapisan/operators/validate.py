"""Checks of records: the first reason to refuse one, or all of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapisan.functions import urls
from tapisan.functions.text import blank


def first_reason(title: Column, paragraphs: Column, image: Column, least_title: int = 5, least_body: int = 10) -> Column:
    """The server's order: title, its bytes, body, its bytes over all paragraphs, image; null if none."""
    size = F.aggregate(F.coalesce(paragraphs, F.array().cast("array<string>")), F.lit(0), lambda s, p: s + F.octet_length(p))
    picture = F.when(blank(image), F.lit("-")).otherwise(image)
    t = F.coalesce(title, F.lit(""))
    return F.when(t == "", "empty_title").when(F.octet_length(t) < least_title, "short_title").when(size == 0, "empty_description").when(size < least_body, "short_description").when(urls.image_error(picture).isNotNull(), "bad_image")


def first_reason_worker(title: Column, category: Column, body: Column, auto_classify: bool = False, least_title: int = 5, least_body: int = 10) -> Column:
    """The worker's order: title, category unless it is to be classified, body of paragraphs joined by blanks. Its image is never refused."""
    t, d = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    out = F.when(t == "", "empty_title").when(F.octet_length(t) < least_title, "short_title")
    if not auto_classify:
        out = out.when(blank(category), "empty_category")
    return out.when(d == "", "empty_description").when(F.octet_length(d) < least_body, "short_description")


def all_reasons(title: Column, image: Column, category: Column, body: Column, url: Column, least_body: int, url_needed: bool) -> Column:
    """Every reason against a page, joined by '; '; '' if there is none."""
    bad_url = urls.source_error(url).isNotNull()
    checks = [
        F.when(blank(title), "missing title"),
        F.when(blank(image), "missing image").when(urls.image_error(image).isNotNull(), "invalid image"),
        F.when(blank(category), "missing category"),
        F.when(F.octet_length(F.coalesce(body, F.lit(""))) < least_body, "short body"),
        F.when(bad_url if url_needed else (~blank(url) & bad_url), "invalid url"),
    ]
    return F.array_join(F.array_compact(F.array(*checks)), "; ")
