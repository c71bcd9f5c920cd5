"""Text functions: key normalization, hashing, sentences, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character that counts as white space, spelled out because the short
# class \s means different sets in different regex engines.
WS_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WS = f"[{WS_CLASS}]"
WORD_CHARS = r"\p{L}\p{N}_"


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only spaces."""
    return F.btrim(col, F.lit(WS_CHARS))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def is_blank(col: Column) -> Column:
    return F.coalesce(strip(col.cast("string")) == "", F.lit(True))


def blank_to_null(col: Column) -> Column:
    return F.when(strip(col) != "", col)


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def plain_spaces(col: Column) -> Column:
    """Every kind of white space as a plain space.

    A character map, because a pattern over this many ranges takes several
    times as long on whole texts; the patterns that follow can then be simple.
    """
    others = WS_CHARS.replace(" ", "")
    return F.translate(col, others, " " * len(others))


def collapse_space(col: Column) -> Column:
    return F.regexp_replace(plain_spaces(col), " {2,}", " ")


def normalize_key(col: Column) -> Column:
    """Lower, strip, keep ``[a-z0-9]`` and white space, then collapse white space.

    Stripping comes first, so removing punctuation can leave a space at the end.
    """
    spaced = F.trim(plain_spaces(F.lower(text_or_empty(col))))
    # Everything but a-z, 0-9 and the space; no upper case is left at this point.
    kept = F.regexp_replace(spaced, r"[\W_&&[^ ]]+", "")
    return F.regexp_replace(kept, " {2,}", " ")


def key_hash(*parts: Column, raw: tuple[Column, ...] = ()) -> Column:
    """SHA-256 over the normalized parts, then the raw ones, joined by ``|``."""
    cleaned = [normalize_key(p) for p in parts] + [text_or_empty(r) for r in raw]
    return F.sha2(F.concat_ws("|", *cleaned), 256)


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(col, r"<[^>]+>", "")


def first_sentence(col: Column, limit: int | None = 300) -> Column:
    """First sentence of tag-free text, or all of it, cut at ``limit`` characters (None: not cut)."""
    flat = strip(strip_tags(text_or_empty(col)))
    # Cut first, so that white space is collapsed in the sentence only.
    sentence = F.regexp_extract(flat, rf"(?s)^(.+?[.!?]){WS}", 1)
    whole = collapse_space(F.coalesce(F.nullif(sentence, F.lit("")), flat))
    return whole if limit is None else F.left(whole, F.lit(limit))


def flat_text(col: Column) -> Column:
    """Tag-free text on one line."""
    return collapse_space(strip(strip_tags(text_or_empty(col))))


def truncate(col: Column, limit: int) -> Column:
    return F.left(col, F.lit(limit))


def split_city(location: Column) -> Column:
    """Text before the first comma; null when blank."""
    return blank_to_null(strip(F.substring_index(location, ",", 1)))


def split_country(location: Column) -> Column:
    """Text after the last comma; null without a comma or when blank."""
    tail = strip(F.substring_index(location, ",", -1))
    return F.when(F.contains(location, F.lit(",")), blank_to_null(tail))


def plain_number(col: Column) -> Column:
    """A number as text, without a trailing ``.0``."""
    whole = F.floor(col)
    return F.when(col == whole, whole.cast("string")).otherwise(col.cast("string"))


def salary_label(low: Column, high: Column, currency: Column) -> Column:
    """``$100K – $150K``, ``$100K+``, ``Up to $150K`` or ``Competitive``; 0 counts as absent."""
    symbol = F.when(F.coalesce(currency, F.lit("USD")) == "INR", "₹").otherwise("$")

    def short(n: Column) -> Column:
        thousands = F.concat(F.floor(n / 1000 + 0.5).cast("string"), F.lit("K"))
        return F.concat(symbol, F.when(n >= 1000, thousands).otherwise(plain_number(n)))

    has_low = F.coalesce(low != 0, F.lit(False))
    has_high = F.coalesce(high != 0, F.lit(False))
    return (
        F.when(has_low & has_high, F.concat(short(low), F.lit(" – "), short(high)))
        .when(has_low, F.concat(short(low), F.lit("+")))
        .when(has_high, F.concat(F.lit("Up to "), short(high)))
        .otherwise("Competitive")
    )


def initials(name: Column) -> Column:
    firsts = F.transform(F.split(name, " "), lambda w: F.left(w, F.lit(1)))
    letters = F.left(F.upper(F.array_join(firsts, "")), F.lit(2))
    return F.when(F.coalesce(name, F.lit("")) == "", "??").otherwise(letters)


def slugify(col: Column) -> Column:
    dashed = F.regexp_replace(F.lower(text_or_empty(col)), r"[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, r"^-|-$", "")


def first_name(full_name: Column) -> Column:
    return F.substring_index(text_or_empty(full_name), " ", 1)


def last_name(full_name: Column) -> Column:
    words = F.split(text_or_empty(full_name), " ")
    return F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ")


def fenced_json(text: Column) -> Column:
    """The body of the first fenced block, or the text itself."""
    tagged = F.regexp_extract(text, r"(?s)```json(.*?)(?:```|\z)", 1)
    plain = F.regexp_extract(text, r"(?s)```(.*?)(?:```|\z)", 1)
    return strip(
        F.when(F.contains(text, F.lit("```json")), tagged)
        .when(F.contains(text, F.lit("```")), plain)
        .otherwise(text)
    )


def escape_like(term: str) -> str:
    """Make ``%``, ``_`` and the escape sign literal in a LIKE pattern."""
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_text(col: Column, term: str) -> Column:
    """Case-insensitive substring test; null stays null."""
    return F.contains(F.lower(col), F.lit(term.lower()))


def resume_file_ok(path: Column, length: Column, extensions: list[str], max_bytes: int) -> Column:
    """Allowed extension and size for an uploaded file's listing entry."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return ext.isin(extensions) & (length <= max_bytes)
