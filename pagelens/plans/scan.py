"""The full run over recorded data: seeds, walk, contacts, verdicts."""

from pyspark.sql import DataFrame, functions as F

from pagelens.functions import fixed_values as V, text, urls
from pagelens.operators import discovery as D, links as L
from pagelens.operators.candidates import generation_wanted
from pagelens.operators.contacts import (
    contact_arrays,
    contacts_and_candidates,
    entries_of,
    entry_evidence,
    extract_contacts,
    first_seen,
    unnest_entries,
)
from pagelens.operators.facts import READ, answered, page_facts, wall_report, with_walls
from pagelens.operators.shared import cut, even_join, small, unnest
from pagelens.operators.verdicts import classify_addresses


def live_seed_hosts(
    domains: DataFrame,
    names: DataFrame,
    asked: DataFrame,
    probes: DataFrame,
    most: int = V.MAX_SEEDS,
) -> DataFrame:
    """``domain, host, url, rank`` of the first ``most`` hosts that answered.

    ``names`` is ``domain, source_order, seq, pos, name`` from certificate
    records. Host order within a domain is that of the first mention, after
    the domain's own hosts when no record has them. Later hosts cannot become
    seeds, so no domain's whole host list is ever sorted in one task.
    """
    under = D.hosts_under(
        names, F.col("domain"), ["seq", "pos"], ["domain", "source_order"]
    )
    chosen = D.source_fallback(under, asked).filter("host IS NOT NULL")
    hosts = D.base_hosts(chosen, domains.select("domain"), ["seq", "pos"])
    order = ["seq", "pos", "host"]
    heads = D.first_k(D.live_hosts(hosts, probes), ["domain"], order, most, into="rank")
    return heads.select("domain", "host", "url", F.col("rank").cast("bigint").alias("rank"))


def scored_seed_links(
    live: DataFrame, pages: DataFrame, entities: DataFrame, max_seeds: int
) -> DataFrame:
    """``domain, url, rank``: best internal links of the first live hosts."""
    heads = D.first_k(live, ["domain"], ["rank"], V.HOSTS_SCORED)
    urls_read = heads.select("url").distinct()
    pages = pages.select("url", "html")
    if small(urls_read):
        homes = pages.join(F.broadcast(urls_read), "url", "left_semi")
    else:
        homes = even_join(pages, urls_read, "url", "left_semi")
    edges = L.link_edges(homes).withColumnRenamed("src", "url")
    named = even_join(
        even_join(edges, heads.select("domain", "url"), "url"), entities, "domain"
    )
    scored = named.withColumn(
        "score", L.scoring.link_score(F.col("dst"), F.col("entity"))
    ).filter(
        urls.is_internal(F.col("dst"), F.col("domain"))
        & (F.col("score") >= V.MIN_LINK_SCORE)
    )
    distinct = (
        scored.withColumn("url", F.rtrim(F.col("dst"), F.lit("/")))
        .groupBy("domain", "url")
        .agg(F.max(F.struct("score", "dst")).alias("best"))
    )
    distinct = even_join(
        distinct, live.select("domain", "url"), ["domain", "url"], "left_anti"
    )
    top = D.first_k(distinct, ["domain"], [F.desc("best")], max_seeds, into="rank")
    return top.select("domain", "url", "rank")


def discover_seeds(
    domains: DataFrame,
    names: DataFrame,
    asked: DataFrame,
    probes: DataFrame,
    pages: DataFrame,
    municipalities: DataFrame | None = None,
    found_urls: DataFrame | None = None,
    max_seeds: int = V.MAX_SEEDS,
) -> DataFrame:
    """Seeds per domain: live hosts, scored links, then saved search results.

    ``found_urls`` is ``domain, url, rank``. Search results rank last, so the
    cap alone decides whether they are used.
    """
    entities = D.with_entity(domains.select("domain").distinct(), municipalities)
    live = cut(
        live_seed_hosts(domains, names, asked, probes, max(max_seeds, V.HOSTS_SCORED))
    )
    stages = [live, scored_seed_links(live, pages, entities, max_seeds)]
    if found_urls is not None:
        stages.append(found_urls)
    return D.seed_cascade(stages, max_seeds)


def discoveries(
    pages: DataFrame,
    target: str | None = None,
    pattern: str = "",
    tld: str = "cl",
) -> DataFrame:
    """Each address once, from the first page that showed it, with evidence.

    ``pages`` carries its order in ``crawl_seq`` or ``depth, path``. Extraction
    and evidence come from one narrow pass; the target filter runs before the
    only shuffle, which carries addresses and not page text.
    """
    return _first_discoveries(_occurrences(pages, target, pattern, tld))


def _occurrences(pages: DataFrame, target, pattern: str, tld: str) -> DataFrame:
    bare = _bare(target)
    order = [c for c in ("crawl_seq", "depth", "path") if c in pages.columns]
    if generation_wanted(pattern, bare, tld):
        return contacts_and_candidates(pages, pattern, bare, tld, order)
    return extract_contacts(
        pages, tld, order, evidence=True, target=bare
    ).withColumn("generated", F.lit(False))


def _bare(target: str | None) -> str | None:
    return target.lower().lstrip("@") if target else None


def _first_discoveries(found: DataFrame) -> DataFrame:
    return first_seen(found).select("email", "source", "generated", "evidence", "hidden")


def page_table(
    pages: DataFrame,
    target: str | None = None,
    pattern: str = "",
    tld: str = "cl",
    contacts: bool = True,
) -> DataFrame:
    """What a run needs of each page, from one parse, without its text.

    ``source, outcome, wall_vendor, anchors`` and, with ``contacts``, the
    ``entries`` of the page and their ``evidence``. The table is checkpointed
    and serves walls, links and contacts. Failed responses are not parsed.
    """
    html = F.when(answered(pages), F.col("html"))
    judged = with_walls(page_facts(pages.withColumn("html", html), links=True))
    anchors = F.transform(
        "facts.anchors", lambda a: F.struct(a["url"].alias("url"), a["pos"].alias("pos"))
    )
    shown = [F.col("url").alias("source"), "outcome", "wall_vendor", anchors.alias("anchors")]
    if contacts:
        bare = _bare(target)
        rows = entries_of(tld, pattern, bare)
        if not generation_wanted(pattern, bare, tld):
            # Texts that cannot hold an address are not searched.
            rows = F.when(text.may_hold_email(F.col("html"), tld), rows)
        judged = contact_arrays(judged, tld).withColumn("entries", rows)
        shown += ["entries", entry_evidence(F.col("entries")).alias("evidence")]
    return cut(judged.select(*shown))


def _table_edges(table: DataFrame) -> DataFrame:
    links = unnest(table, ["source"], F.col("anchors"), "a", "at")
    return links.select(
        F.col("source").alias("src"), F.col("a.url").alias("dst"), F.col("a.pos").alias("pos")
    ).filter(urls.is_http(F.col("dst")))


def _walk(table: DataFrame, seeds: DataFrame, max_depth, max_pages, scope, tld):
    judged = table.withColumnRenamed("source", "url")
    return L.crawl_frontier(
        _table_edges(table), seeds, judged, max_depth, max_pages, scope, tld
    )


def walk_snapshot(
    pages: DataFrame,
    seeds: DataFrame,
    max_depth: int = 3,
    max_pages: int | None = None,
    scope: str = "tld",
    tld: str = "cl",
) -> DataFrame:
    """Walk a snapshot from its seeds; pages are parsed once for their links.

    With ``scope='tld'`` pages outside the TLD can only be read as seeds. When
    the seeds are a counted small set they are broadcast and all other foreign
    pages are dropped before the parse. Seeds are checkpointed first, so what
    found them runs once.
    """
    seeds = cut(seeds.select("url", "rank"))
    table = page_table(_walkable(pages, seeds, scope, tld), contacts=False)
    return _walk(table, seeds, max_depth, max_pages, scope, tld)


def _walkable(pages: DataFrame, seeds: DataFrame, scope: str, tld: str) -> DataFrame:
    named = seeds.select("url").distinct()
    if scope != "tld" or not small(named):
        return pages
    flagged = F.broadcast(named.withColumn("__seed", F.lit(True)))
    return (
        pages.join(flagged, "url", "left")
        .filter(urls.in_tld(F.col("url"), tld) | F.col("__seed").isNotNull())
        .drop("__seed")
    )


def _read_on_walk(walk: DataFrame, table: DataFrame) -> DataFrame:
    """Occurrences on the walked pages, with the walk's order.

    Only addresses meet the walk, never page text; a walk as long as the
    table is an even join on the page's address.
    """
    order = walk.filter(F.col("outcome") == READ).select(
        F.col("url").alias("source"), "depth", "path"
    )
    return unnest_entries(table, []).join(order, "source")


def scan(
    pages: DataFrame,
    seeds: DataFrame,
    mx: DataFrame,
    replies: DataFrame | None = None,
    catch_all: DataFrame | None = None,
    target: str | None = None,
    pattern: str = "",
    tld: str = "cl",
    max_depth: int = 3,
    max_pages: int | None = 2000,
    scope: str = "tld",
    smtp_enabled: bool = True,
) -> dict:
    """Full run; gives the tables ``walk``, ``results`` and ``walls``."""
    seeds = cut(seeds.select("url", "rank"))
    table = page_table(_walkable(pages, seeds, scope, tld), target, pattern, tld)
    walk = _walk(table, seeds, max_depth, max_pages, scope, tld)
    found = _first_discoveries(_read_on_walk(walk, table))
    return {
        "walk": walk,
        "results": classify_addresses(found, mx, replies, catch_all, smtp_enabled, tld),
        "walls": wall_report(walk),
    }
