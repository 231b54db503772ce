"""Chat formatting: layouts, round trips of any text, masks, odd rows."""

import hashlib
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from siteatlas.llm import chat_format as C
from siteatlas.llm import queries

CONTROLS = ["<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|any thing|>"]
U, A, S = "user", "assistant", "system"
CASES = [
    ("messages", {"messages": [{"role": U, "content": "q"}, {"role": A, "content": None, "meta": {"k": 1}}], "id": 4}, [(U, "q"), (A, "")]),
    ("message_parts", {"messages": [{"role": U, "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, [(U, "ab")]),
    ("from_value", {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "[1, 2]"}, {"from": "tool", "value": "t"}]},
     [(U, "q"), (A, "[1, 2]"), ("tool", "t")]),
    ("turn", {"role": "Human", "text": "q"}, [("Human", "q")]),
    ("instruction", {"instruction": "do", "input": "", "output": "done"}, [(U, "do"), (A, "done")]),
    ("instruction", {"system": "s", "instruction": "do", "input": "this", "output": "done", "source": {"x": [1]}}, [(S, "s"), (U, "do\n\nthis"), (A, "done")]),
    ("prompt_response", {"prompt": '[{"role": "user"}]', "response": '{"a": 1}'}, [(U, '[{"role": "user"}]'), (A, '{"a": 1}')]),
    ("prompt_completion", {"completion": "c", "prompt": "p"}, [(U, "p"), (A, "c")]),
    ("question_answer", {"context": "c", "question": "q", "answer": "a"}, [(U, "c\n\nq"), (A, "a")]),
    ("completion", {"completion": ""}, [(A, "")]),
]


def test_layouts(spark):
    rows = [(i, 0, json.dumps(record), "x", "y") for i, (_, record, _) in enumerate(CASES)]
    got = C.convert(spark.createDataFrame(rows, "conv_id long, turn long, record string, role string, text string")).collect()
    for i, (name, _, turns) in enumerate(CASES):
        mine = sorted((r for r in got if r.conv_id == i), key=lambda r: r.part)
        assert [(r.role, r.text) for r in mine] == turns and {r.layout for r in mine} == {name}


def test_unknown_records_stay_whole(spark):
    odd = [None, "", "no json", "[1]", "{}", '{"messages": []}', '{"messages": "x"}', '{"prompt": "p", "messages": [{"role": "u", "content": "c"}]}']
    got = C.convert(spark.createDataFrame([(i, None, r) for i, r in enumerate(odd)], "conv_id long, turn long, record string")).collect()
    assert sorted((r.conv_id, r.role, r.text, r.layout) for r in got) == [(i, "", r or "", None) for i, r in enumerate(odd)]
    assert C.convert(spark.createDataFrame([], "conv_id long, turn long, record string")).collect() == []


def test_fingerprints_tell_layouts_apart():
    every = [f for layout in C.LAYOUTS for f in layout.fingerprints()]
    assert len(every) == len(set(every))


def round_trip(spark, rows):
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, part int")
    formatted = C.format_turns(turns)
    return formatted.collect(), C.parsed(formatted).collect()


pieces = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "\n", "s>", "/s>", "|", ">", "INST]", "é", "😀", "n>", "x"]), max_size=12).map("".join)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.tuples(pieces, pieces | st.text(max_size=20).filter(lambda t: t.isprintable())), min_size=5, max_size=30))
def test_any_text_comes_back(spark, texts):
    rows = [(i, 0, A if i % 2 else role, text) for i, (role, text) in enumerate(texts)]
    formatted, back = round_trip(spark, rows)
    assert sorted((r.conv_id, r.role, r.text) for r in back) == [(i, role, text) for i, _, role, text in rows]
    assert all((r.loss if r.loss is not None else "") == (r.text if r.role == A else "") for r in back)
    for r in formatted:
        inner = r.formatted[len(C.START):-len(C.END)]
        assert not any(c in inner for c in CONTROLS[:8]) and not re.search(r"<\|[^|>]*\|>", inner)


def test_mask_is_the_text_in_code_points(spark):
    formatted, _ = round_trip(spark, [(1, 0, A, "é😀</s>z"), (1, 1, U, "q"), (1, 2, None, None)])
    one = next(r for r in formatted if r.turn == 0)
    assert one.formatted[one.loss_start:one.loss_start + one.loss_length] == "é😀<\\/s>z"
    assert all(r.loss_length == 0 for r in formatted if r.turn)


def test_digest_of_odd_rows(spark):
    long = "long [INST] " * 20_000
    rows = [(1, 0, U, "a"), (1, 0, U, "a"), (1, 1, A, None), (1, None, S, "first"), (None, 3, A, long), (None, 4, A, "b"), (2, 0, None, "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1)).repartition(3)
    got = {r.conv_id: r for r in C.digest(C.format_turns(C.convert(C.as_records(turns)))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha("system\nfirst\nuser\na\nuser\na\nassistant\n\n")
    assert got[1].loss_chars == 0 and got[1].loss_sha256 == sha("")
    assert got[None].loss_sha256 == sha(long + "b") and got[None].loss_chars == len(long) + 1
    assert got[None].formatted_chars == len(long) + 20_000 + 1 + 2 * (24 + len(A))
    assert got[2].turns_sha256 == sha("\n\n")


def test_probe(spark):
    got = queries.op13_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = queries.PROBE[0][3]
    assert got.n_turns == 2 and got.loss_chars == len(text) and got.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


@pytest.mark.parametrize("text", CONTROLS)
def test_every_control_string_is_broken(spark, text):
    one = spark.createDataFrame([(text,)], "t string").select(C.escaped(F.col("t")).alias("e")).first()["e"]
    assert text not in one and len(one) == len(text) + 1
