"""Text, hash, JSON and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------
BASIC_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#x27;", "'")]
FINAL_ERROR_TEXTS = ["net::err_aborted", "invalid url", "protocol error"]
# -----------------------------------------------------------------------------


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_html(text: Column) -> Column:
    out = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in BASIC_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return trimmed(out)


def sanitize(text: Column, max_length: int = 500) -> Column:
    return trimmed(F.substring(strip_html(text), 1, max_length))


def _has_string(kind: T.DataType) -> bool:
    if isinstance(kind, T.StringType):
        return True
    if isinstance(kind, T.StructType):
        return any(_has_string(f.dataType) for f in kind.fields)
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType)


def sanitize_nested(column: Column, kind: T.DataType, max_length: int = 1000) -> Column:
    """Sanitize every string of a nested value; of arrays only string items."""
    if not _has_string(kind):
        return column
    if isinstance(kind, T.StringType):
        return sanitize(column, max_length)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda item: sanitize(item, max_length))
    fields = [sanitize_nested(column[f.name], f.dataType, max_length).alias(f.name) for f in kind.fields]
    return F.when(column.isNotNull(), F.struct(*fields))


def is_valid_name(text: Column) -> Column:
    return text.rlike(r"^[a-zA-Z0-9\s\-_.,()]{1,200}$")


def slug(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), r"[^a-z0-9\s\-]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+", "-"), r"-+", "-")
    return trimmed(out)


def truncate(text: Column, limit: int) -> Column:
    flat = trimmed(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def visual_hash(image: Column, fallback: Column) -> Column:
    """Hash of the first 10,000 base64 characters; ``fallback`` without an image."""
    encoded = F.substring(F.regexp_replace(F.base64(image), r"\s", ""), 1, 10000)
    has_image = image.isNotNull() & (F.octet_length(image) > 0)
    return F.when(has_image, content_hash(encoded)).otherwise(fallback)


def structure_hash(links: Column, forms: Column, title: Column) -> Column:
    return F.xxhash64(links.cast("bigint"), forms.cast("bigint"), title)


def fingerprint_similarity(a, b) -> Column:
    """Score of two fingerprints with fields title, links, forms, length.

    ``a`` and ``b`` are anything indexable by field name.
    """
    same_title = F.when(a["title"] == b["title"], F.lit(0.4)).otherwise(F.lit(0.0))
    apart = F.abs(a["links"] - b["links"]) + F.abs(a["forms"] - b["forms"])
    structure = F.lit(1.0) - F.least(apart, F.lit(20)) / F.lit(20.0)
    longest = F.greatest(a["length"], b["length"])
    delta = F.abs(a["length"] - b["length"])
    length = (F.when(longest > 0, F.lit(1.0) - F.least(delta / longest, F.lit(1.0)))
              .otherwise(F.lit(1.0)))
    return same_title + structure * F.lit(0.3) + length * F.lit(0.3)


def sitemap_priority(priority: Column) -> Column:
    """0.0 counts as missing."""
    return (F.when(priority.isNull() | (priority == 0), F.lit(10))
            .otherwise(F.floor((1 - priority) * 20 + 0.5))).cast("int")


def backoff_ms(attempt: Column, base_ms: int = 2000) -> Column:
    return F.lit(base_ms) * F.pow(F.lit(2.0), attempt)


def error_key(kind: Column, message: Column) -> Column:
    return F.concat(kind, F.lit(": "), F.substring(F.coalesce(message, F.lit("")), 1, 100))


def is_retryable(retries: Column, message: Column, max_retries: int = 2) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    final = F.lit(False)
    for text in FINAL_ERROR_TEXTS:
        final = final | F.contains(low, F.lit(text))
    return (retries < max_retries) & ~final


def outermost_json(text: Column) -> Column:
    """Text from the first ``{`` to the last ``}``; NULL when there is none."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)
