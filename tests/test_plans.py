import contextlib
import io

import pytest
from pyspark.sql import functions as F

from siteatlas.operators import blocks, stats
from siteatlas.plans import catalog

SMALL = "/root/testdata/sf0.001"


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def tables(spark):
    return catalog.Tables(spark, SMALL)


def test_catalog_is_complete():
    entries = catalog.load()
    assert len(entries) > 190
    assert all(e.sql for e in entries.values())


@pytest.mark.parametrize("name", ["agg_patterns", "win_pattern_cap", "join_robots", "join_two_hop", "agg_project_stats", "win_change", "dd_url", "join_canonical"])
def test_no_cross_product(tables, name):
    text = plan(catalog.load()[name].build(tables))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_caps_limit_groups_before_the_shuffle(tables):
    text = plan(stats.top_patterns(tables.pages.select(F.col("page_id").alias("seq"), "url")))
    assert "WindowGroupLimit" in text


def test_streaks_never_window_over_a_domain_alone(tables):
    text = plan(blocks.failure_streaks(tables.crawl_events))
    assert "_chunk0" in text


def test_scan_reads_only_what_is_asked(tables):
    text = plan(catalog.load()["agg_usage_events"].build(tables))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in text
    text = plan(catalog.load()["scan_list"].build(tables))
    assert "EqualTo(o_custkey,77)" in text


def test_results_do_not_depend_on_layout(spark, tables):
    rows = tables.crawl_events
    def result(df):
        return sorted(map(tuple, blocks.failure_signals(df, 2, 50).collect()))
    assert result(rows) == result(rows.repartition(7).sortWithinPartitions(F.desc("seq")))


def test_flagship(spark):
    import __spark_entry__ as entry

    top = entry.entry(spark).collect()
    assert len(top) == 10
    assert all(r.kept == min(r.total, 3) and r.skipped == r.total - r.kept for r in top)
    assert [r.kept for r in top] == sorted((r.kept for r in top), reverse=True)
