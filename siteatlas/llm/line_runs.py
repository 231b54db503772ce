"""Repeated runs of lines, found by winnowing over line hashes.

A gram is ``gram`` consecutive content lines (blank ones do not count).  From every ``window`` consecutive grams the smallest
hash is selected, the last one of equals, so two documents that share a run of ``gram + window - 1`` lines select a common
fingerprint in it: that is the guarantee, and the shortest run that counts.  A single line of ``long_words`` words or more
is a run, and a fingerprint, by itself.

Positions are joined by fingerprint, and those whose fingerprint occurs again are extended to both sides: all shortest runs
around the position are compared with their first occurrence.  Their union is the longest match, and every line of it that
repeats an earlier one is deleted.  A fingerprint's positions are never paired with each other, only with the first
occurrence, which is found by an aggregate that combines before the shuffle.  Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteatlas.llm.common import identified, text_mark, unpacked, whole_row
from siteatlas.session import cut_lineage

_BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _content(text: Column, long_words: int) -> Column:
    """``{at, h, g, long}`` of every line that is not blank: place, two hashes of the trimmed line, and if it is long."""
    trimmed = F.transform(_lines(text), lambda x, i: F.struct(i.alias("at"), F.trim(x, F.lit(_BLANKS)).alias("x")))
    full = F.filter(trimmed, lambda p: p["x"] != "")
    return F.transform(full, lambda p: F.struct(
        p["at"].alias("at"), F.xxhash64(p["x"]).alias("h"), F.xxhash64(F.lit(1), p["x"]).alias("g"),
        (F.size(F.split(p["x"], "[ \\t\\x0B\\f\\r]+")) >= long_words).alias("long")))


def _runs(content: Column, gram: int, window: int) -> Column:
    """``{print, h, g, first, last}`` of every shortest run: its fingerprint, its two hashes and its lines."""
    size = gram + window - 1

    def run(lines: Column, i: Column) -> Column:
        part = [F.get(lines, i + k) for k in range(size)]
        grams = F.array(*[F.struct(F.xxhash64(*[part[j + k]["h"] for k in range(gram)]).alias("v"), F.lit(-j).alias("j"))
                          for j in range(window)])
        return F.struct(F.array_min(grams)["v"].alias("print"), F.xxhash64(*[p["h"] for p in part]).alias("h"),
                        F.xxhash64(*[p["g"] for p in part]).alias("g"), part[0]["at"].alias("first"), part[-1]["at"].alias("last"))

    def runs(lines: Column) -> Column:
        starts = F.when(F.size(lines) >= size, F.sequence(F.lit(0), F.size(lines) - size)).otherwise(F.array().cast("array<int>"))
        single = F.transform(F.filter(lines, lambda x: x["long"]), lambda x: F.struct(
            x["h"].alias("print"), x["h"].alias("h"), x["g"].alias("g"), x["at"].alias("first"), x["at"].alias("last")))
        return F.concat(F.transform(starts, lambda i: run(lines, i)), single)

    return F.transform(F.array(content), runs)[0]


def repeated(docs: DataFrame, gram: int = 1, window: int = 2, long_words: int = 50) -> DataFrame:
    """``doc_id, mark, lines``: the places (from 0) of the lines to delete, for each document that has any."""
    ident = identified(docs)
    runs = ident.select("doc_id", text_mark(F.col("text")).alias("mark"),
                        F.explode(_runs(_content(F.col("text"), long_words), gram, window)).alias("r")).select("doc_id", "mark", "r.*")
    runs = cut_lineage(runs, "line-runs")
    # Fingerprints at two places or more.  Copies of one stored row are one document, hence the distinct places.
    place = F.struct("doc_id", "mark", "first")
    prints = runs.groupBy("print").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z").select("print")
    # Written out, both sides of a join are plain exchanges, of which AQE splits a hot key.
    prints = cut_lineage(prints, "line-prints")
    shared = runs.join(prints, "print", "left_semi")
    firsts = shared.groupBy("h", "g").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z").select("h", "g", "a")
    firsts = cut_lineage(firsts, "line-firsts")
    later = runs.join(firsts, ["h", "g"]).where(place > F.col("a"))
    return later.groupBy("doc_id", "mark").agg(
        F.array_distinct(F.flatten(F.collect_set(F.sequence("first", "last")))).alias("lines"))


def _joined(docs: DataFrame, gone: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(whole_row(docs), docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), text_mark(text).alias("mark"))
    g = gone.select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"), "lines")
    return rows.join(g, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left")


def _kept_text() -> Column:
    """The text without its deleted lines: places left over are looked up one by one, so long texts stay linear."""
    places = F.array_except(F.sequence(F.lit(0), F.size(_lines(F.col("text"))) - 1), F.col("lines"))
    kept = F.transform(F.array(F.struct(_lines(F.col("text")).alias("l"), places.alias("p"))),
                       lambda x: F.array_join(F.transform(x["p"], lambda i: F.get(x["l"], i)), "\n"))[0]
    return F.when(F.col("lines").isNull(), F.col("text")).otherwise(kept)


def remove(docs: DataFrame, gram: int = 1, window: int = 2, long_words: int = 50) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` of every row, with the later repeats of line runs gone.

    The first occurrence by (doc_id, place) stays; within a document, too.  Blank lines inside a deleted run go with it.
    Lines are compared without outer blanks.  Null or empty text: one empty line, nothing to delete.  Repeated rows (same
    id and text) are one document, and both stay alike; rows that share only the id are ordered by a hash of the text; null
    ids come first.  Empty table: no rows.  Other columns are left alone.
    """
    out = _joined(docs, repeated(docs, gram, window, long_words))
    return out.select("doc_id", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
                      F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), _kept_text().alias("text"))


def clean(docs: DataFrame, gram: int = 1, window: int = 2, long_words: int = 50) -> DataFrame:
    """The documents with ``text`` (and ``n_chars``, if there) as ``remove`` leaves it; no row goes."""
    out = _joined(docs, repeated(docs, gram, window, long_words))
    new = {"text": F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(_kept_text())}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("lines").isNull(), F.col("row.n_chars")).otherwise(
            F.length(_kept_text()).cast(docs.schema["n_chars"].dataType))
    return out.select(*unpacked(docs.columns, new))


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
