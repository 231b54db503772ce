"""Chat formatting by schema fingerprints.

Conversations come as JSON records of many shapes: lists of messages, prompt and completion, instruction and output, one turn a
record.  A record's nested field paths, those that some known layout names, are hashed; the hash selects the layout, a declaration of
where the turns are, what their roles are called and which fields make their texts.  What comes out are canonical turns.

A turn is written as ``<|im_start|>role LF text<|im_end|> LF``.  In role and text a backslash follows every backslash and the first
character of every control string, so none of them occurs inside a text and the text can be had back.  A formatted conversation is the
concatenation of its turns' rows, in order; the loss mask of a row is the place of an assistant's text in it, in code points.

Everything is done row by row with Spark's own expressions; a record that holds a very long conversation gives a row for each turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- layouts


@dataclass(frozen=True)
class Field:
    """A turn of a fixed role; its text is that of the given top-level fields that hold one, two line feeds between."""

    role: str
    names: tuple[str, ...]


@dataclass(frozen=True)
class Layout:
    """``paths`` must all be there, ``optional`` ones may.  Turns are either ``fields`` or the elements of the list ``each``."""

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    fields: tuple[Field, ...] = ()
    each: str | None = None
    role: str = "role"
    text: str = "content"
    parts: str | None = None  # the text is the list of this field of the elements of ``text``
    roles: tuple[tuple[str, str], ...] = ()  # other names of the canonical roles

    def fingerprints(self) -> list[str]:
        return [fingerprint((*self.paths, *extra)) for n in range(len(self.optional) + 1) for extra in combinations(self.optional, n)]


def fingerprint(paths) -> str:
    return hashlib.md5("\n".join(sorted(set(paths))).encode(), usedforsecurity=False).hexdigest()


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), each="messages"),
    Layout("message_parts", ("messages[].role", "messages[].content[].text"), ("messages[].content[].type",), each="messages", parts="text"),
    Layout("from_value", ("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value", roles=(
        ("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))),
    Layout("turn", ("role", "text")),
    Layout("message", ("role", "content")),
    Layout("instruction", ("instruction", "output"), ("system", "input"), fields=(
        Field("system", ("system",)), Field("user", ("instruction", "input")), Field("assistant", ("output",)))),
    Layout("prompt_response", ("prompt", "response"), ("system",), fields=(
        Field("system", ("system",)), Field("user", ("prompt",)), Field("assistant", ("response",)))),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), fields=(
        Field("system", ("system",)), Field("user", ("prompt",)), Field("assistant", ("completion",)))),
    Layout("question_answer", ("question", "answer"), ("context",), fields=(
        Field("user", ("context", "question")), Field("assistant", ("answer",)))),
    Layout("prompt", ("prompt",), fields=(Field("user", ("prompt",)),)),
    Layout("completion", ("completion",), fields=(Field("assistant", ("completion",)),)),
    Layout("system", ("system",), fields=(Field("system", ("system",)),)),
)
# Lists and objects below which paths are followed: messages, [], content, [], text.
DEPTH = 5


def field_paths(value: Column, depth: int = DEPTH, name: Column | None = None) -> Column:
    """Array of the paths of all fields of a variant; ``[]`` stands for the elements of a list, null for a value that is none."""
    if depth == 0:
        return F.array(name)

    def below(inner: Column, part: Column) -> Column:
        return field_paths(inner, depth - 1, part if name is None else F.concat(name, part))

    dot = F.lit("" if name is None else ".")
    fields = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    found = F.flatten(F.transform(fields, lambda e: below(e["value"], F.concat(dot, e["key"]))))
    if name is None:
        return found
    elements = F.try_variant_get(value, "$", "array<variant>")
    listed = F.array_distinct(F.flatten(F.transform(elements, lambda x: below(x, F.lit("[]")))))
    return F.coalesce(found, F.when(F.size(listed) > 0, listed), F.array(name))


def record_fingerprint(value: Column) -> Column:
    """Fingerprint of a variant: the hash of those of its paths that some layout names."""
    known = sorted({p for layout in LAYOUTS for p in (*layout.paths, *layout.optional)})
    named = F.array_intersect(field_paths(value), F.array(*map(F.lit, known)))
    return F.md5(F.array_join(F.sort_array(named), "\n"))


def _turns(layout: Layout, value: Column) -> Column:
    """array<struct<role, text>> of a record of one layout."""
    def field(name: str) -> Column:
        return F.coalesce(F.try_variant_get(value, f"$.{name}", "string"), F.lit(""))

    def turn(role: Column, text: Column) -> Column:
        named = F.coalesce(role, F.lit(""))
        for name, canonical in layout.roles:
            named = F.when(role == name, canonical).otherwise(named)
        return F.struct(named.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if layout.each:
        inner = f"array<struct<{layout.parts}:string>>" if layout.parts else "string"
        kind = f"array<struct<`{layout.role}`:string,`{layout.text}`:{inner}>>"

        def text(x: Column) -> Column:
            return F.array_join(F.transform(x[layout.text], lambda p: p[layout.parts]), "") if layout.parts else x[layout.text]

        return F.transform(F.try_variant_get(value, f"$.{layout.each}", kind), lambda x: turn(x[layout.role], text(x)))
    if not layout.fields:
        role, text = layout.paths
        return F.array(turn(field(role), field(text)))
    made = []
    for item in layout.fields:
        texts = F.filter(F.array(*map(field, item.names)), lambda x: x != "") if len(item.names) > 1 else F.array(field(item.names[0]))
        one = F.array(turn(F.lit(item.role), F.array_join(texts, "\n\n")))
        absent = F.array_max(F.array(*[F.try_variant_get(value, f"$.{n}", "variant").isNotNull() for n in item.names]))
        made.append(F.when(absent, one).otherwise(F.slice(one, 1, 0)))
    return F.concat(*made)


def convert(records: DataFrame, id_col: str = "conv_id", order_col: str = "turn", record_col: str = "record") -> DataFrame:
    """``conv_id, turn, part, role, text, layout`` of JSON records: a row for each turn, ``part`` counting those of a record.

    A null text is empty.  A record of no known layout, one that is no JSON object, null, or beyond the size of a variant gives one
    row with a null layout, an empty role and the record as its text, so nothing is lost and nothing is guessed.  A list of no
    messages counts as such.  Repeated records and ids give their rows each.  Empty table: no rows.  Other columns are not read.
    """
    given = records.select(records[id_col].cast("long").alias("conv_id"), records[order_col].cast("long").alias("turn"),
                           records[record_col].alias("record"), F.try_parse_json(records[record_col]).alias("value"))
    named = F.create_map(*[F.lit(x) for layout in LAYOUTS for f in layout.fingerprints() for x in (f, layout.name)])
    chosen = given.withColumn("layout", F.try_element_at(named, record_fingerprint(F.col("value"))))
    turns = F.lit(None)
    for layout in LAYOUTS:
        turns = F.when(F.col("layout") == layout.name, _turns(layout, F.col("value"))).otherwise(turns)
    raw = F.array(F.struct(F.lit("").alias("role"), F.coalesce("record", F.lit("")).alias("text")))
    read = chosen.select("conv_id", "turn", "layout", "record", turns.alias("turns"))
    read = read.withColumn("layout", F.when(F.size("turns") > 0, F.col("layout")))
    rows = read.select("conv_id", "turn", "layout", F.posexplode(F.when(F.col("layout").isNotNull(), F.col("turns")).otherwise(raw)).alias("part", "t"))
    return rows.select("conv_id", "turn", "part", F.col("t.role").alias("role"), F.col("t.text").alias("text"), "layout")


# ---- template

START, END, LOSS_ROLE = "<|im_start|>", "<|im_end|>\n", "assistant"
# Control strings of this template and of others whose marks a tokenizer may know: <|any name|>, <s>, </s>, <<SYS>>, [INST] and their ends.
_MARKED = r"\\|<(?=\|[^|>]*\|>|/?s>|</?SYS>>)|\[(?=/?INST\])"
_LINE_FEED = "<\\n>"  # a line feed in a role; escaping never gives this


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _MARKED, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, part, formatted, loss_start, loss_length`` of canonical turns: the mask is empty but in an assistant's turn.

    Null roles and texts are empty.  Only rows of a known layout belong here; other columns are left behind.
    """
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(_LINE_FEED))
    text = escaped(F.coalesce("text", F.lit("")))
    rows = turns.select("conv_id", "turn", "part", "role", role.alias("_role"), text.alias("_text"))
    learned = F.col("role").eqNullSafe(LOSS_ROLE)
    return rows.select(
        "conv_id", "turn", "part", F.concat(F.lit(START), "_role", F.lit("\n"), "_text", F.lit(END)).alias("formatted"),
        F.when(learned, F.length("_role") + len(START) + 1).otherwise(0).cast("int").alias("loss_start"),
        F.when(learned, F.length("_text")).otherwise(0).cast("int").alias("loss_length"))


def write(turns: DataFrame, path: str) -> None:
    """Formatted turns as Parquet, in the layout of the input: no row moves."""
    format_turns(turns).write.mode("overwrite").option("compression", "zstd").parquet(path)


def parsed(formatted: DataFrame) -> DataFrame:
    """``conv_id, turn, part, role, text, loss, formatted_chars`` from formatted rows alone; ``loss`` is null outside the mask."""
    body = F.substring("formatted", F.lit(len(START) + 1), F.length("formatted") - len(START) - len(END))
    rows = formatted.withColumn("_body", body).withColumn("_role", F.substring_index("_body", "\n", 1))
    masked = F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length"))
    return rows.select(
        "conv_id", "turn", "part", unescaped(F.replace("_role", F.lit(_LINE_FEED), F.lit("\n"))).alias("role"),
        unescaped(F.substring("_body", F.length("_role") + 2, F.length("_body"))).alias("text"),
        F.when(F.col("loss_start") > 0, unescaped(masked)).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))


# ---- digest

def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of equal conv_id, whatever its length: only running hashes are kept."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, done = None, []

    def closed() -> list:
        return [now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]]

    for batch in batches:
        ids, roles, texts, losses, chars = (batch.column(c).to_pylist() for c in range(5))
        for conv, role, text, loss, size in zip(ids, roles, texts, losses, chars, strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    done.append(closed())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            now[1] += 1
            now[2].update(f"{role}\n{text}\n".encode())
            if loss is not None:
                now[3] += len(loss)
                now[4].update(loss.encode())
            now[5] += size
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
            done = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(closed(), types, strict=True)], names=names)


def digest(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, a row for each conversation.

    Turns of equal number count in the order of part, role and text.  A conversation is hashed as a stream by one task, as its hash
    is one of a sequence; its rows are sorted by Spark, which spills, and never held.
    """
    # Formatted rows move, and are parsed where they arrive.
    rows = parsed(formatted.repartition("conv_id")).sortWithinPartitions("conv_id", "turn", "part", "role", "text")
    return rows.select("conv_id", "role", "text", "loss", "formatted_chars").mapInArrow(
        _conversations, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


# ---- records of a turn table

def as_records(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, record`` of a table of turns, each turn as JSON of one of four layouts, dealt by conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    layout = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(4))
    options = {"ignoreNullFields": "false"}
    usual = role.isin("user", "assistant", "system")
    called = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    plain = F.to_json(F.struct(role.alias("role"), text.alias("text")), options)
    record = (
        F.when(layout == 1, F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages")), options))
        .when((layout == 2) & usual, F.to_json(F.struct(F.array(F.struct(called.alias("from"), text.alias("value"))).alias("conversations")), options))
        .when((layout == 3) & (role == "user"), F.to_json(F.struct(text.alias("prompt"))))
        .when((layout == 3) & (role == "assistant"), F.to_json(F.struct(text.alias("completion"))))
        .when((layout == 3) & (role == "system"), F.to_json(F.struct(text.alias("system")))).otherwise(plain))
    return turns.select("conv_id", "turn", record.alias("record"))
