"""Page structure tables, all row-local projections of the page scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siteatlas.functions import html as H
from siteatlas.functions import urls as U
from siteatlas.functions.bind import let, let_all

# ---- fixed values -----------------------------------------------------------
SAMPLE_VALUES = [
    ("search", "test"), ("q", "test"), ("query", "test"), ("keyword", "example"), ("name", "John Doe"),
    ("email", "test@example.com"), ("city", "New York"), ("zip", "10001"), ("country", "US"), ("state", "NY"),
    ("category", "all"), ("type", "all"), ("sort", "name"), ("order", "asc"), ("limit", "10"),
    ("per_page", "10"), ("lang", "en"), ("locale", "en"),
]
# -----------------------------------------------------------------------------

def staged(pages: DataFrame) -> DataFrame:
    """Pages with script-free HTML as ``bare``, scanned out once."""
    return pages.withColumn("bare", H.drop_scripts(F.col("html")))


def page_structure(pages: DataFrame) -> DataFrame:
    """One nested row per page; html itself is not carried on."""
    bare, url = F.col("bare"), F.col("url")
    raw = staged(pages).withColumn("raw_links", H.raw_links(bare))
    extra = [c for c in pages.columns if c not in ("page_id", "url", "html")]
    return raw.select(
        "page_id", "url", *extra, H.title(bare).alias("title"), H.links_from(F.col("raw_links"), url).alias("links"),
        H.forms(bare, url).alias("forms"), H.buttons(bare).alias("buttons"), H.meta(bare).alias("meta"),
        H.headings(bare).alias("headings"), H.is_spa(F.col("html")).alias("is_spa"),
        F.length("html").alias("text_length"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href, text): resolved out-links."""
    raw = pages.select("page_id", "url", H.raw_links(H.drop_scripts(F.col("html"))).alias("raw"))
    return raw.select("page_id", F.posexplode(H.links_from(F.col("raw"), F.col("url"))).alias("position", "link")).select(
        "page_id", "position", "link.href", "link.text")


def exploded(pages: DataFrame, rows: Column) -> DataFrame:
    """(page_id, position, fields...) of an array of structs or values."""
    return pages.select("page_id", F.posexplode(rows).alias("position", "item"))


def form_inputs(pages: DataFrame) -> DataFrame:
    forms = exploded(staged(pages), H.forms(F.col("bare"), F.col("url"))).select(
        "page_id", F.col("position").alias("form"), "item.action", "item.method", F.explode_outer("item.inputs").alias("i"))
    return forms.select("page_id", "form", "action", "method", "i.name", "i.type", "i.required")


def field_labels(pages: DataFrame) -> DataFrame:
    """(page_id, id, label): every control with the text of the first label that names it, found within the page's row."""
    found = let_all({"known": H.labels(F.col("bare")), "controls": H.control_blocks(F.col("bare"))}, lambda v: F.transform(
        v["controls"], lambda c: let(H.head_tag(c), lambda tag: F.struct(
            H.attr(tag, "id").alias("id"), H.label_for(v["known"], tag).alias("label")))))
    return staged(pages).select("page_id", F.inline(found))


def sample_value(name: Column) -> Column:
    """First sample whose key is in the field name or holds it; a fixed list."""
    low = F.lower(name)
    value = F.lit(None).cast("string")
    for key, sample in reversed(SAMPLE_VALUES):
        value = F.when(F.contains(low, F.lit(key)) | F.contains(F.lit(key), low), F.lit(sample)).otherwise(value)
    return value


def form_urls(bare: Column, url: Column, max_forms: int = 3) -> Column:
    """Where the first GET forms would lead with sample values, as array<string>."""
    def field(c: Column, tag: Column) -> Column:
        return F.struct(
            H.tag_name(tag).alias("element"), H.attr(tag, "name").alias("name"), H.control_type(tag).alias("type"),
            H.has_attr(tag, "required").alias("required"), H.control_value(c).alias("value"),
            F.try_element_at(H.select_options(c), F.lit(1)).alias("option"))

    def fields(block: Column) -> Column:
        found = F.transform(H.control_blocks(block), lambda c: let(H.head_tag(c), lambda tag: field(c, tag)))
        return F.filter(found, lambda f: (f["name"] != "") & (f["element"] != "textarea"))

    def filled(f: Column) -> Column:
        value = F.coalesce(H.or_null(f["value"]), f["option"], sample_value(f["name"]),
                           F.when(f["required"], F.lit("test")))
        return F.concat(F.url_encode(f["name"]), F.lit("="),
                        F.url_encode(F.when(~f["type"].isin("hidden", "submit"), value)))

    forms = let(U.base_of(url), lambda base: F.transform(H.form_blocks(bare), lambda b: let(
        H.head_tag(b), lambda tag: F.struct(
            H.form_action(tag, url, base).alias("action"), H.form_method(tag).alias("method"),
            fields(b).alias("fields")))))
    asked = F.slice(F.filter(forms, lambda f: (f["method"] == "GET") & (F.size(f["fields"]) > 0)), 1, max_forms)
    return F.transform(asked, lambda f: F.concat(
        F.regexp_replace(f["action"], r"[?#].*$", ""), F.lit("?"),
        F.array_join(F.array_compact(F.transform(f["fields"], filled)), "&")))


def form_targets(pages: DataFrame, max_forms: int = 3) -> DataFrame:
    """(page_id, form, target_url) of GET forms; never submitted."""
    found = exploded(staged(pages), form_urls(F.col("bare"), F.col("url"), max_forms))
    return found.select("page_id", F.col("position").alias("form"), F.col("item").alias("target_url"))


def dom_summary(pages: DataFrame) -> DataFrame:
    """Title, first ten headings and four element counts."""
    bare = F.col("bare")
    return staged(pages).select(
        "page_id", "url", H.title(bare).alias("title"),
        F.slice(F.transform(H.headings(bare, "1-3", first=10, max_text=1 << 20), lambda h: h["text"]), 1, 10).alias("headings"),
        F.size(H.open_tags(bare, "form")).alias("form_count"),
        F.size(F.filter(H.open_tags(bare, "a"), lambda t: H.has_attr(t, "href"))).alias("link_count"),
        F.size(H.open_tags(bare, "input|select|textarea")).alias("input_count"),
        F.size(H.open_tags(bare, "button")).alias("button_count"))


def prompt_elements(pages: DataFrame, limit: int = 20) -> DataFrame:
    """Inputs, then buttons, first ``limit``: (page_id, position, type, name, label, required, text)."""
    bare = F.col("bare")
    none = F.lit("")
    tags = F.filter(F.transform(H.control_blocks(bare), lambda c: H.head_tag(c)),
                    lambda tag: F.lower(H.attr(tag, "type")) != "hidden")
    inputs = let(H.labels(bare), lambda known: F.transform(tags, lambda tag: F.struct(
        H.control_type(tag).alias("type"), H.attr(tag, "name").alias("name"),
        F.coalesce(H.label_for(known, tag), H.attr(tag, "placeholder")).alias("label"),
        H.has_attr(tag, "required").alias("required"), none.alias("text"))))
    presses = F.transform(H.button_blocks(bare, ("submit",), roles=False), lambda b: F.struct(
        F.lit("button").alias("type"), none.alias("name"), none.alias("label"), F.lit(False).alias("required"),
        H.button_text(b).alias("text")))
    rows = exploded(staged(pages), F.slice(F.concat(inputs, presses), 1, limit))
    return rows.select("page_id", "position", "item.*")


def doc_page(pages: DataFrame) -> DataFrame:
    """What a documentation page needs: headings, forms, button texts, link count."""
    bare = F.col("bare")
    heads = F.filter(F.transform(H.headings(bare, "1-3", first=1 << 20, max_text=1 << 20), lambda h: h["text"]),
                     lambda t: t != "")
    presses = F.filter(F.transform(H.button_blocks(bare, ("submit",)), lambda b: H.text_of(b)),
                       lambda t: (t != "") & (F.length(t) < 50))
    extra = [c for c in pages.columns if c not in ("page_id", "url", "html")]
    return staged(pages).select(
        "page_id", "url", *extra, H.title(bare).alias("title"), F.slice(heads, 1, 10).alias("headings"),
        F.size(H.open_tags(bare, "form")).alias("forms"), F.slice(presses, 1, 10).alias("buttons"),
        F.size(F.filter(H.open_tags(bare, "a"), lambda t: H.has_attr(t, "href"))).alias("links"))


def metadata(structure: DataFrame) -> DataFrame:
    """Meta map of each page with the counted facts laid over it."""
    facts = F.create_map(
        F.lit("title"), F.col("title"), F.lit("url"), F.col("url"),
        F.lit("isSPA"), F.col("is_spa").cast("string"),
        F.lit("headingCount"), F.size("headings").cast("string"), F.lit("formCount"), F.size("forms").cast("string"),
        F.lit("buttonCount"), F.size("buttons").cast("string"), F.lit("linkCount"), F.size("links").cast("string"))
    others = F.map_filter("meta", lambda k, v: ~k.isin(
        "title", "url", "isSPA", "headingCount", "formCount", "buttonCount", "linkCount"))
    return structure.select("page_id", F.map_concat(others, facts).alias("metadata"))


Processor = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class PageStep:
    """A Python step over one page at a time: ``column`` becomes ``function`` of the named columns' values."""

    column: str
    inputs: tuple[str, ...]
    function: Callable
    kind: T.DataType


def _page_step(step: PageStep) -> Column:
    """``{value, failed}`` of each page; what the function raises fails that page alone."""
    shape = T.StructType([T.StructField("value", step.kind), T.StructField("failed", T.BooleanType())])

    @F.arrow_udf(shape)
    def run(*columns: pa.Array) -> pa.Array:
        values, failed = [], []
        for row in zip(*(c.to_pylist() for c in columns), strict=True):
            try:
                values.append(step.function(*row))
                failed.append(False)
            except Exception:  # noqa: BLE001 - a user step may raise anything
                values.append(None)
                failed.append(True)
        return pa.StructArray.from_arrays([pa.array(values, to_arrow_type(step.kind)), pa.array(failed, pa.bool_())], ["value", "failed"])

    return run(*[F.col(c) for c in step.inputs])


def run_processors(pages: DataFrame, processors: list[tuple[str, Processor | PageStep]]) -> tuple[DataFrame, list[str]]:
    """Apply named steps in order and note, for each page, those that failed.

    A DataFrame step that cannot be planned is skipped for all pages; a page
    step that raises leaves NULL on that page, and the page goes on.
    """
    out, failed = pages.withColumn("_failed_processors", F.array().cast("array<string>")), []
    for name, step in processors:
        noted = F.array_append("_failed_processors", F.lit(name))
        if isinstance(step, PageStep):
            out = out.withColumn("_step", _page_step(step)).withColumns({
                step.column: F.col("_step.value"),
                "_failed_processors": F.when(F.col("_step.failed"), noted).otherwise(F.col("_failed_processors"))}).drop("_step")
            continue
        try:
            out = step(out)
        except Exception:  # noqa: BLE001 - a user step may raise anything
            failed.append(name)
            out = out.withColumn("_failed_processors", noted)
    return out, failed


def drop_downloads(structure: DataFrame) -> DataFrame:
    """Keep links that lead to pages, not to files."""
    return structure.withColumn("links", F.filter("links", lambda l: ~U.is_download(F.lower(l["href"]))))
