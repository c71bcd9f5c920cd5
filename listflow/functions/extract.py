"""Values pulled out of free text, URLs and HTML."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from listflow.functions import fixed_values as fv
from listflow.functions.text import blank_to_null, plain_spaces, strip, strip_tags, text_or_empty

ANCHOR = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


def salary_range(text: Column, patterns: list[str] = fv.SALARY_PATTERNS) -> Column:
    """Struct ``(min, max)``; values below 1000 count as thousands. White space is of any kind."""
    text = plain_spaces(text)

    def number(raw: Column) -> Column:
        value = F.regexp_replace(raw, ",", "").try_cast("double")
        return F.when(value < 1000, value * 1000).otherwise(value)

    out = None
    for p in patterns:
        low, high = F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2)
        found = F.struct(number(low).alias("min"), number(high).alias("max"))
        out = F.when(low != "", found) if out is None else out.when(low != "", found)
    return out


def compensation_range(text: Column) -> Column:
    """``$90k-$120k`` as struct ``(min, max)``; unreadable parts are null."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\$", ""), "k", "000"), ",", "")
    parts = F.split(plain, "-")
    low = strip(F.try_element_at(parts, F.lit(1))).try_cast("double")
    high = strip(F.try_element_at(parts, F.lit(2))).try_cast("double")
    has_dash = F.coalesce(F.contains(text, F.lit("-")), F.lit(False))
    return F.struct(
        F.when(has_dash, low).alias("min"),
        F.when(has_dash & low.isNotNull(), high).alias("max"),
    )


ENTITIES = [("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def decode_entities(col: Column) -> Column:
    """The common character entities; the ampersand comes last."""
    for name, char in ENTITIES:
        col = F.replace(col, F.lit(name), F.lit(char))
    return col


def inner_text(col: Column) -> Column:
    return strip(decode_entities(strip_tags(col)))


def anchors(html: Column) -> Column:
    """Array of ``(pos, href, label)`` for the anchors of a page in document order."""
    hrefs = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))
    labels = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2))
    pairs = F.zip_with(hrefs, labels, lambda h, l: F.struct(h.alias("href"), inner_text(l).alias("label")))
    return F.transform(
        pairs,
        lambda p, i: F.struct(i.alias("pos"), p["href"].alias("href"), p["label"].alias("label")),
    )


def first_element_text(html: Column, tags: list[str], default: str | None = None) -> Column:
    """Text of the first of the given tags that has any, tried in order."""
    found = [
        blank_to_null(inner_text(F.regexp_extract(html, rf"(?is)<{t}(?:\s[^>]*)?>(.*?)</{t}>", 1)))
        for t in tags
    ]
    return F.coalesce(*found, F.lit(default)) if default is not None else F.coalesce(*found)


def site_origin(url: Column) -> Column:
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("HOST")))


def resolve_href(href: Column, origin: Column) -> Column:
    """Root-relative links get the site's origin; others stay."""
    return F.when(F.startswith(href, F.lit("/")), F.concat(origin, href)).otherwise(href)


def link_or_site(href: Column, origin: Column) -> Column:
    """Links that are not absolute get the site's origin."""
    return F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(origin, text_or_empty(href)))
