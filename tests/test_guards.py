"""Cuts that must not be silent, folders that must be shared, failures that stay where they belong."""

import datetime
import os
import shutil
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteatlas import session
from siteatlas.operators import frontier, ordered, structure
from siteatlas.operators.dom import _number
from siteatlas.sources import archive, tables


def fake(master, named=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: named),
                           sparkContext=SimpleNamespace(master=master, applicationId=master, getCheckpointDir=lambda: None))


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("spark://host:7077"))
    assert session.shared_dir(fake("spark://host:7077", "hdfs://x/tmp/")) == "hdfs://x/tmp"
    assert session.shared_dir(fake("local[2]")) == session.shared_dir(fake("local[2]"))


def test_a_local_session_makes_its_folder_once(spark):
    folder = session.shared_dir(spark)
    assert folder and session.shared_dir(spark) == folder
    assert session.cut_lineage(spark.range(3), "three").count() == 3


def test_the_entry_works_without_the_training_text_part(tmp_path):
    """A copy of the repository without both its folders and the pipeline, or with the pipeline alone left, still gives the other queries."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name, left_out in (("bare", ("llm", "corpus_pipeline.py")), ("orphan", ("llm",))):
        target = tmp_path / name
        target.mkdir()
        shutil.copytree(f"{here}/siteatlas", target / "siteatlas", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for file in ("__spark_entry__.py", "corpus_pipeline.py"):
            if file not in left_out and os.path.exists(f"{here}/{file}"):
                shutil.copy(f"{here}/{file}", target / file)
        code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
        env = {**os.environ, "PYTHONPATH": str(target)}
        said = subprocess.run([sys.executable, "-c", code], cwd=target, env=env, capture_output=True, text=True, timeout=120)
        assert said.returncode == 0, said.stderr
        count, *rest = said.stdout.split()
        assert int(count) > 190 and rest == ["False", "False", "True"]


def test_files_of_a_round_can_be_dropped(spark):
    kept = session.cut_lineage(spark.range(5), "kept")
    gone = session.cut_lineage(spark.range(5), "gone")
    session.forget(gone)
    files, where = session._file_system(spark, gone._written_at)
    assert not files.exists(where) and kept.count() == 5


def test_first_n_above_the_threshold_of_a_group_limit(spark):
    rows = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    got = ordered.first_n(rows, ["k"], ["o"], 3000).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("o").alias("last")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 3000, 5998), (1, 3000, 5999)]


def test_declarations_do_not_end_the_tree():
    for bad in ("<![foo[x]]>", "<![CDATA[x]]>", "<![", "<!x [", "<!ATTLIST %", "<!doctype [ <!ELEMENT"):
        _number(f"<p>a{bad}")
        assert [n["tag"] for n in _number(f"<p>a{bad}></p><i>b</i>")][-1] in ("i", "p")
    assert [n["tag"] for n in _number("<p>a<![foo[x]]>b<i>c</i></p>")] == ["p", "i"]


def test_a_page_step_fails_page_by_page(spark):
    def half(n):
        if n % 2:
            raise ValueError(n)
        return n // 2

    out, failed = structure.run_processors(spark.range(4).withColumnRenamed("id", "n"), [
        ("half", structure.PageStep("h", ("n",), half, T.LongType())), ("none", lambda d: d.select("nowhere"))])
    assert failed == ["none"]
    assert sorted((r.n, r.h, tuple(r._failed_processors)) for r in out.collect()) == [
        (0, 0, ("none",)), (1, None, ("half", "none")), (2, 1, ("none",)), (3, None, ("half", "none"))]


def test_a_broken_hook_names_its_stage(spark):
    with pytest.raises(RuntimeError, match="afterFetch"):
        frontier.run_hooks(spark.range(1), "afterFetch", [frontier.Hook("x", "no_such > 1")]).collect()


def test_checkpoint_ids_are_text(spark, tmp_path):
    tables.save_checkpoint({"queue": spark.range(3)}, str(tmp_path), "007", "2024-01-01 00:00:00")
    tables.save_checkpoint({"queue": spark.range(5)}, str(tmp_path), "7", "2024-01-02 00:00:00")
    assert tables.load_checkpoint(spark, str(tmp_path), "queue", "007").count() == 3
    assert tables.load_checkpoint(spark, str(tmp_path), "queue").count() == 5
    with pytest.raises(ValueError):
        tables.save_checkpoint({"queue": spark.range(1)}, str(tmp_path), "a/b", "2024-01-01 00:00:00")


def test_checkpoints_of_many_crawls_in_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([("007", 1), ("7", 2), ("7", 3)], "checkpoint_id string, page long")
    taken = spark.createDataFrame([("007", "2024-01-01"), ("7", "2024-01-02"), ("empty", "2023-01-01")], "id string, taken_at string")
    tables.save_checkpoints({"queue": rows}, str(tmp_path), taken)
    tables.save_checkpoints({"queue": rows.where("page = 2")}, str(tmp_path), taken.where("id = '7'"))
    sizes = tables.checkpoint_sizes(spark, str(tmp_path), ("queue",))
    assert sorted((r.id, r.queue) for r in sizes.collect()) == [("007", 1), ("7", 1), ("empty", 0)]
    assert [r.page for r in tables.load_checkpoint(spark, str(tmp_path), "queue").collect()] == [2]
    with pytest.raises(Exception, match="not a checkpoint id: a/b"):
        tables.save_checkpoints({"queue": rows.withColumn("checkpoint_id", F.lit("a/b"))}, str(tmp_path), taken)


def test_retention_drops_days_and_rewrites_the_edge(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(hours=6 * i), 100) for i in range(20)]
    archive.store_days(spark.createDataFrame(rows, "seq long, captured_at timestamp, total_size_bytes long"), str(tmp_path))
    report = archive.expire(spark, str(tmp_path), F.lit(datetime.datetime(2024, 1, 4, 12)), 1).orderBy("day").collect()
    assert [(r.day, r.deleted_snapshots, r.freed_bytes) for r in report] == [("2024-01-01", 4, 400), ("2024-01-02", 4, 400), ("2024-01-03", 2, 200)]
    assert sorted(r.seq for r in archive.read_days(spark, str(tmp_path)).collect()) == list(range(10, 20))
    assert not (tmp_path / "day=2024-01-01").exists()
    archive.fit_quota(spark, str(tmp_path), 350)
    assert sorted(r.seq for r in archive.read_days(spark, str(tmp_path)).collect()) == [17, 18, 19]
