"""Pieces of HTML pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerwatch import config as C
from offerwatch.functions.text import non_empty


def plain_text(html: Column) -> Column:
    """Tags to blanks, white space collapsed; entities stay as they are."""
    untagged = F.regexp_replace(F.coalesce(html, F.lit("")), C.TAG, " ")
    return F.trim(F.regexp_replace(untagged, r"(?U)\s+", " "))


def segments(html: Column, pattern: str = C.CARD) -> Column:
    """Every match's first group, in page order."""
    return F.regexp_extract_all(html, F.lit(pattern), 1)


def absolute_url(url: Column) -> Column:
    """Protocol-relative to https; empty to null."""
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(non_empty(url))


def image_bases(images: Column, limit: int) -> Column:
    """The first `limit` usable image URLs of an array<struct<url>>."""
    urls = F.transform(images, lambda image: absolute_url(image["url"]))
    return F.slice(F.coalesce(F.array_compact(urls), F.array().cast("array<string>")), 1, limit)


def gallery(images: Column, limit: int) -> Column:
    return F.transform(image_bases(images, limit), lambda url: F.concat(url, F.lit(C.FULL_SUFFIX)))


def thumbnail(images: Column, limit: int) -> Column:
    return F.concat(F.get(image_bases(images, limit), F.lit(0)), F.lit(C.THUMB_SUFFIX))


def first_hosted_image(html: Column) -> Column:
    """URL of the first image tag that points at the listing-photo host."""
    tags = F.regexp_extract_all(html, F.lit(C.CARD_IMAGE_TAG), 0)
    urls = F.transform(tags, lambda tag: non_empty(F.regexp_extract(tag, C.CARD_IMAGE_URL, 1)))
    return F.get(F.array_compact(urls), F.lit(0))
