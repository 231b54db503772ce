"""Odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import corpus_pipeline
import pytest
from siteatlas.llm import (
    decontaminate,
    licenses,
    line_runs,
    order_minhash,
    packing,
    quality_ledger,
    substrings,
    token_files,
    toxicity,
    url_blocks,
)
from siteatlas.llm.common import prepare, tokenizer_file

TOKENIZER = tokenizer_file("word_bpe_49k.json")
CLASH = "doc_id long, text string, lang string, source string, n_chars long, n_words long, row string, mark int, lines string, hits int, m int, node string, h long, failed long"


def odd_rows():
    long_text = " ".join(f"w{i % 4093}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (None, "no id here, but some words to read"), (None, None), (5, long_text),
             (5, long_text), (6, "same id, first text"), (6, "same id, second text"), (7, "é ñ ß 中文 \u0000 x"), (8, "a\n\n\na\nb\na\nb"),
             (9, "Released under the MIT License."), (10, "x" * 50_000)]
    return [(i, t, None, "s", 3, 4, "r", 5, "l", 6, 7, "n", 8, 9) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    return spark.createDataFrame(odd_rows(), CLASH).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


def items(spark):
    return spark.createDataFrame([(1, "one"), (2, None), (None, "some words to read"), (3, ""), (1, "one")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 0), (None, 1), (5, 1), (5, 0), (4, None)], "doc_id long, toxic int")


def whole(kind):
    return {
        "search": lambda s, d: decontaminate.digest(decontaminate.search(d, items(s))),
        "lines": lambda s, d: line_runs.digest(line_runs.remove(d)),
        "licenses": lambda s, d: licenses.digest(licenses.scan(d)),
        "quality": lambda s, d: quality_ledger.digest(quality_ledger.ledger(d)),
        "substrings": lambda s, d: substrings.digest(substrings.remove(d)),
        "near": lambda s, d: order_minhash.digest(order_minhash.group(d)),
        "toxicity": lambda s, d: toxicity.digest(toxicity.score(d, toxicity.fit(d, labels(s)))),
    }[kind]


ROWWISE = ("search", "lines", "licenses", "quality", "substrings", "near", "toxicity")


@pytest.mark.parametrize("kind", ROWWISE)
def test_a_row_for_each_row(spark, odd, kind):
    got = whole(kind)(spark, odd).collect()
    assert len(got) == len(odd_rows())
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in odd_rows())
    twins = [r for r in got if r.doc_id == 5]
    assert twins[0] == twins[1]


@pytest.mark.parametrize("kind", ROWWISE)
def test_empty_table(spark, none, kind):
    assert whole(kind)(spark, none).collect() == []


def test_empty_benchmark(spark, odd):
    got = decontaminate.search(odd, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == len(odd_rows()) and not any(r.hits for r in got) and max(r.n_words for r in got) == 60_000


def test_token_files(spark, odd, none, tmp_path):
    for name, docs, rows in (("odd", odd, len(odd_rows())), ("none", none, 0)):
        token_files.write(docs, str(tmp_path / name), TOKENIZER, chunk_ids=5000)
        got = token_files.digest(token_files.read(spark, str(tmp_path / name))).orderBy("start").collect()
        assert len(got) == rows
        assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
        ids = [r.doc_id for r in got]
        assert ids == sorted(ids, key=lambda x: (x is not None, x))


def test_packing(spark, odd, none):
    assert packing.pack(none, TOKENIZER).collect() == []
    got = packing.pack(odd, TOKENIZER).collect()
    assert sum(r.length for r in got if r.doc_id == 5) == 2 * next(r.doc_tokens for r in got if r.doc_id == 5)
    assert {r.doc_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}


def test_urls(spark):
    prepare(spark)
    rows = [(1, None, None), (2, "", ""), (3, "no scheme", "<p>"), (None, "http://a.net/x", None), (4, "HTTP://B.Example.NET/en/x?q#f", "x"),
            (4, "HTTP://B.Example.NET/en/x?q#f", "x"), (5, "http://x.com", "<link rel=canonical>"), (6, "http://", "<link rel=canonical href='//z.org/a b'>")]
    got = url_blocks.digest(url_blocks.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in got) == sorted([
        ("1", "", "", None, "allow"), ("2", "", "", None, "allow"), ("3", "", "", None, "allow"), ("None", "a.net", "/x", "net/", "block"),
        ("4", "b.example.net", "/en/x", "example.net/en/", "allow"), ("4", "b.example.net", "/en/x", "example.net/en/", "allow"),
        ("5", "x.com", "", None, "allow"), ("6", "", "", None, "allow")])
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_blocks.judge_pages(empty).collect() == []


def test_stages_keep_all_columns(spark, odd, none, tmp_path):
    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == packing.pack(docs, TOKENIZER).count()


def test_one_row_of_each_group_stays(spark, odd):
    ids = sorted(str(r.doc_id) for r in order_minhash.keep_one(odd).collect())
    # Empty texts are one class, kept by its row without an id; rows that repeat are one.
    assert ids == sorted(["None", "None", "4", "5", "6", "6", "7", "8", "9", "10"])


def test_line_text(spark, odd):
    got = {r.doc_id: (r.n_removed, r.text) for r in line_runs.remove(odd).collect()}
    # "a b" starts again after its first place; the blank lines between are not inside that run.
    assert got[8] == (2, "a\n\n\na\nb")
    assert got[3][0] == 0 and got[2] == (0, "")
