"""Frontier planning as table jobs: what to visit next, and why not."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteatlas.functions import html as H
from siteatlas.functions import text as X
from siteatlas.functions import urls as U
from siteatlas.operators import dedup, ordered
from siteatlas.operators.structure import form_urls, staged
from siteatlas.session import cut_lineage
from siteatlas.sources.robots import mark_allowed

# ---- fixed values -----------------------------------------------------------
ORIGIN_PRIORITIES = {"seed": 0, "route": 5, "form": 7, "hash": 8, "link": 10, "frame": 12, "pagination": 15}
# -----------------------------------------------------------------------------



def recorded_redirects(pairs: DataFrame) -> DataFrame:
    """Redirects that lead elsewhere; a URL that redirects to itself is dropped."""
    return pairs.where(F.col("start") != F.col("final"))


def redirect_chains(pairs: DataFrame, rows: int = ordered.CHUNK_ROWS) -> DataFrame:
    """(start, hop, final, hops): the targets of each start in arrival order.

    One row per hop instead of one list per start, so a hot start stays spread.
    """
    known = recorded_redirects(pairs)
    numbered = ordered.running_totals(known, ["start"], [ordered.chunk_of("seq", rows)], ["seq"], {"hop": F.lit(1).cast("bigint")})
    hops = known.groupBy("start").agg(F.count(F.lit(1)).alias("hops"))
    return numbered.join(hops, "start").select("start", "hop", "final", "hops")


def pagination_cap(requests: DataFrame, order: list[str], cap: int = 10) -> DataFrame:
    """Add ``kept``: at most ``cap`` pagination URLs per digit-collapsed URL."""
    page_key = F.when(U.is_pagination(F.col("url")), U.page_pattern(F.col("url")))
    return ordered.mark_first_n(requests.withColumn("page_pattern", page_key), ["page_pattern"], order, cap, "kept")


def schedule(requests: DataFrame, health: DataFrame, delay_ms: int = 1000, rows: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Add ``start_ms``: earliest start by position in the domain and its delay."""
    numbered = ordered.running_totals(requests, ["domain"], [F.col("priority"), ordered.chunk_of("seq", rows)],
                                      ["priority", "seq"], {"_n": F.lit(1).cast("bigint")})
    slowed = numbered.join(health.select("domain", "multiplier"), "domain", "left")
    start = (F.col("_n") - 1) * F.lit(delay_ms) * F.coalesce("multiplier", F.lit(1.0))
    return slowed.withColumn("start_ms", start).drop("_n", "multiplier")


def result_page(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Page ``page`` (from 1) of a sorted result, with the number of pages."""
    total = rows.agg(F.ceil(F.count(F.lit(1)) / F.lit(size))).scalar()
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).withColumn("total_pages", total)


def search_projects(projects: DataFrame, text: str) -> DataFrame:
    """Projects whose name or base URL holds ``text``, whatever the case."""
    wanted = F.lit(text.lower())
    return projects.where(F.contains(F.lower("name"), wanted) | F.contains(F.lower("base_url"), wanted))


def redirect_loops(pairs: DataFrame, max_redirects: int = 5) -> DataFrame:
    """URLs inside a chain of at least ``max_redirects`` hops."""
    known = recorded_redirects(pairs)
    long = known.groupBy("start").agg(F.count(F.lit(1)).alias("hops")).where(F.col("hops") >= max_redirects)
    return known.join(long, "start", "left_semi").select(F.col("final").alias("url")).distinct()


def candidates(pages: DataFrame, scope: U.Scope | None = None) -> DataFrame:
    """URLs found on pages: (seq, position, url, origin, priority, depth, parent_url).

    Needs page_id, url, html, depth.  One pass per page; sources come in a
    fixed order and positions number them.  Attribute routes count only on
    framework pages or where fewer than three links were found.
    """
    bare, url = F.col("bare"), F.col("url")
    raw = staged(pages).withColumn("raw_links", H.raw_links(bare))
    found = raw.select(
        "page_id", "url", "depth", F.transform(H.links_from(F.col("raw_links"), url), lambda l: l["href"]).alias("links"),
        H.is_spa(F.col("html")).alias("is_spa"), F.transform(H.attr_routes(bare, url), lambda r: r["url"]).alias("routes"),
        H.hash_routes(F.col("html"), bare, url).alias("hashes"), H.frames(bare, url).alias("frames"),
        form_urls(bare, url, 2).alias("forms"), H.pagination(bare, url)["next_url"].alias("next_url"))

    def rows(urls: Column, origin: str, deeper: int = 1) -> Column:
        return F.transform(urls, lambda u: F.struct(
            u.alias("url"), F.lit(origin).alias("origin"), F.lit(ORIGIN_PRIORITIES[origin]).alias("priority"),
            F.lit(deeper).alias("deeper")))

    none = F.array().cast("array<string>")
    few = F.col("is_spa") | (F.size("links") < 3)
    every = F.concat(
        rows(F.col("links"), "link"), rows(F.when(few, F.col("routes")).otherwise(none), "route"),
        rows(F.col("hashes"), "hash"), rows(F.col("frames"), "frame"), rows(F.col("forms"), "form"),
        rows(F.when(F.col("next_url").isNotNull(), F.array("next_url")).otherwise(none), "pagination", 0))
    out = found.select(F.col("page_id").alias("seq"), F.col("url").alias("parent_url"), "depth", F.posexplode(every).alias("position", "c"))
    out = out.select("seq", "position", "c.url", "c.origin", "c.priority", (F.col("depth") + F.col("c.deeper")).alias("depth"), "parent_url")
    if scope is None:
        return out
    return out.where((F.col("origin") == "pagination") | U.scope_reason(F.col("url"), scope).isNull())


def preflight(queue: DataFrame, visited: DataFrame, scope: U.Scope, robots: DataFrame, loops: DataFrame,
              health: DataFrame, page_cap: int = 10) -> DataFrame:
    """Add ``skip_reason`` (NULL: may be fetched) to queued requests.

    Needs seq, url, priority.  Checks run in a fixed order and the pagination
    count grows only with requests that passed the earlier ones.  Requests that
    were visited before vanish without being counted.
    """
    fresh = dedup.unseen(queue, visited)
    # One row per request and no page text: cheaper to store than to redo the
    # URL checks for the count and again for the rows it is joined to.
    ruled = mark_allowed(fresh, robots, "_robots")
    looped = ruled.join(loops.select("url", F.lit(True).alias("_loop")), "url", "left")
    early = (F.when(U.scope_reason(F.col("url"), scope).isNotNull(), F.lit("navigation strategy"))
             .when(~F.col("_robots"), F.lit("disallowed by robots.txt"))
             .when(F.col("_loop"), F.lit("redirect loop detected")))
    checked = cut_lineage(looped.withColumn("_early", early), "preflight")
    page_key = F.when(F.col("_early").isNull() & U.is_pagination(F.col("url")), U.page_pattern(F.col("url")))
    capped = ordered.mark_first_n(checked.withColumn("_pages", page_key), ["_pages"], ["priority", "seq"], page_cap, "_kept")
    blocked = health.where("blocked").select(F.col("domain").alias("_host"), F.lit(True).alias("_blocked"))
    placed = capped.withColumn("_host", U.hostname(F.col("url"))).join(blocked, "_host", "left")
    reason = F.coalesce(F.col("_early"), F.when(~F.col("_kept"), F.lit(f"pagination cap ({page_cap})")),
                        F.when(F.col("_blocked"), F.lit("domain blocked")))
    return placed.select(*queue.columns, reason.alias("skip_reason"))


def skip_report(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("skip_reason").isNotNull()).groupBy("skip_reason").agg(F.count(F.lit(1)).alias("skipped"))


def next_round(checked: DataFrame, per_domain: int, size: int) -> DataFrame:
    """The next ``size`` requests: passed, at most ``per_domain`` of a domain, by priority."""
    open_ = checked.where(F.col("skip_reason").isNull()).withColumn("domain", U.hostname(F.col("url")))
    slots = ordered.first_n(open_, ["domain"], ["priority", "seq"], per_domain).drop("rank")
    return slots.orderBy("priority", "seq").limit(size)


def retries(failures: DataFrame, max_retries: int = 2) -> DataFrame:
    """Add ``will_retry`` and the retried request's count and priority."""
    again = X.is_retryable(F.col("retry_count"), F.col("error_message"), max_retries)
    return failures.withColumns({
        "will_retry": again, "retry_count": F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
        "priority": F.when(again, F.col("priority") + 5).otherwise(F.col("priority"))})


def depths(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): hops from the seeds over (src, dst), up to ``max_depth``.

    Breadth-first: each round joins only the newest nodes with the edges and
    drops the reached ones.  Rounds are written to the shared folder, so a lost
    executor costs one round and plans stay flat.
    """
    links = cut_lineage(edges.select("src", "dst").distinct(), "depth-edges")
    reached = cut_lineage(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "depth-0")
    newest = reached
    for level in range(1, max_depth + 1):
        step = links.join(newest.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        newest = cut_lineage(step.join(reached, "node", "left_anti").withColumn("depth", F.lit(level)), f"depth-{level}")
        if newest.isEmpty():
            break
        reached = reached.unionByName(newest)
    return reached


# ---- hooks --------------------------------------------------------------------------

@dataclass(frozen=True)
class Hook:
    """What a stage does to the requests it looks at: change columns, or end the stage for them.

    ``when`` and the values of ``changes`` are SQL expressions or Columns over the
    request; ``ends`` is aborted, skipped or cancelled.
    """

    name: str
    when: str | Column = "true"
    changes: dict[str, str | Column] = field(default_factory=dict)
    ends: str | None = None


def run_hooks(requests: DataFrame, stage: str, hooks: list[Hook]) -> DataFrame:
    """Apply a stage's hooks in order and add ``_ended``; what ended a request keeps later hooks off it.

    A hook that cannot be planned fails the stage with its name, as a broken hook does.
    """
    column = lambda c: F.expr(c) if isinstance(c, str) else c
    out = requests.withColumn("_ended", F.lit(None).cast("string"))
    for hook in hooks:
        try:
            active = F.col("_ended").isNull() & F.coalesce(column(hook.when), F.lit(False))
            new = {c: F.when(active, column(v)).otherwise(F.col(c)) for c, v in hook.changes.items()}
            out = out.withColumns({**new, "_ended": F.when(active, F.lit(hook.ends)).otherwise(F.col("_ended"))})
        except Exception as error:  # noqa: BLE001 - a user hook may raise anything
            raise RuntimeError(f'Hook "{stage}" failed: {error}') from error
    return out
