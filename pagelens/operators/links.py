"""JOB link_edges and JOB crawl_frontier: the link graph of a snapshot."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pagelens.functions import fixed_values as V, scoring, urls
from pagelens.operators.facts import READ, page_facts, with_outcome
from pagelens.operators.shared import cut


def link_edges(pages: DataFrame, entity: str | None = None) -> DataFrame:
    """``src, dst, pos`` of every absolute http(s) link, ``score`` on request."""
    edges = (
        page_facts(pages, links=True)
        .select(F.col("url").alias("src"), F.explode("facts.anchors").alias("a"))
        .select("src", F.col("a.url").alias("dst"), F.col("a.pos").alias("pos"))
        .filter(urls.is_http(F.col("dst")))
    )
    if entity is None:
        return edges
    return edges.withColumn("score", scoring.link_score(F.col("dst"), entity))


def internal_edges(pages: DataFrame, domain, entity: str = "company") -> DataFrame:
    """FLT-7 and FLT-8: internal links worth following, with their score."""
    return link_edges(pages, entity).filter(
        urls.is_internal(F.col("dst"), domain)
        & (F.col("score") >= V.MIN_LINK_SCORE)
    )


def rank_links(scored: DataFrame, keys: list | None = None) -> DataFrame:
    """TOP-1: distinct links, best score first, ties by URL descending.

    The distinct step combines on the map side; the sort is a range sort.
    """
    best = scored.groupBy(*(keys or []), "dst").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), F.desc("dst"))


def crawl_frontier(
    edges: DataFrame,
    seeds: DataFrame,
    pages: DataFrame,
    max_depth: int = 3,
    max_pages: int | None = None,
    scope: str = "tld",
    tld: str = "cl",
) -> DataFrame:
    """Breadth-first walk over a snapshot: ``url, depth, path``, judgements.

    ``seeds`` is ``url, rank``; ``pages`` is ``url, wall_vendor, outcome``, one
    row per URL. ``path`` holds the link positions from the seed down. Comparing paths
    item by item gives queue order inside a depth, so the first way to reach a
    URL is a plain ``min(path)`` by URL, which combines on the map side: no
    global rank is needed and a page linked from everywhere is no hot group.

    Pages out of scope or missing from the snapshot are dropped, walls and
    failed responses are kept and not expanded, and the walk ends with the ``max_pages``-th
    readable page. One round runs per depth. The edges, the page list and
    each round are checkpointed, so page text is read once and a lost executor
    costs one round.
    """
    known = cut(with_outcome(pages).select("url", "wall_vendor", "outcome"))
    steps = cut(
        edges.select("src", F.col("dst").alias("url"), "pos").filter(
            urls.in_scope(F.col("url"), F.lit(False), scope, tld)
        )
    )
    first = seeds.groupBy("url").agg(
        F.min(F.array(F.col("rank").cast("int"))).alias("path")
    )
    level = cut(first.join(known, "url"))
    rounds = [level.withColumn("depth", F.lit(0))]
    read = _readable(level)
    for depth in range(1, max_depth + 1):
        if max_pages is not None and read >= max_pages:
            break
        expanded = level.filter(F.col("outcome") == READ).select(
            F.col("url").alias("src"), F.col("path").alias("from")
        )
        reached = (
            steps.join(expanded, "src")
            .groupBy("url")
            .agg(F.min(F.concat("from", F.array("pos"))).alias("path"))
        )
        visited = reduce(DataFrame.unionByName, rounds).select("url")
        level = cut(
            reached.join(visited, "url", "left_anti").join(known, "url")
        )
        found = _readable(level)
        rounds.append(level.withColumn("depth", F.lit(depth)))
        if found == 0:
            break
        read += found
    walked = reduce(DataFrame.unionByName, rounds)
    return walked if max_pages is None else cap_pages(walked, max_pages)


def _readable(level: DataFrame) -> int:
    return level.filter(F.col("outcome") == READ).count()


def cap_pages(
    walked: DataFrame, max_pages: int, order: list | None = None
) -> DataFrame:
    """TOP-4: keep the walk up to its ``max_pages``-th readable page.

    Unreadable pages before that point are kept and cost nothing. Pages are
    dealt into ranges of their order and counted; only the range that holds
    the last page is sorted, so any number of pages may be asked for.
    """
    key = F.struct(*(order or ["depth", "path"]))
    walked = with_outcome(walked)
    read = F.col("outcome") == READ
    ranges = cut(
        walked.filter(read)
        .select(key.alias("__at"))
        .repartitionByRange("__at")
        .withColumn("__range", F.spark_partition_id())
    )
    left = max_pages
    for number, count in sorted(ranges.groupBy("__range").count().collect()):
        if count >= left:
            inside = ranges.filter(F.col("__range") == number)
            last = inside.orderBy("__at").limit(left).agg(F.max("__at").alias("at"))
            return (
                walked.withColumn("__last", last.scalar())
                .filter(key <= F.col("__last"))
                .drop("__last")
            )
        left -= count
    return walked
