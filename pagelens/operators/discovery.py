"""Seed URLs of an organisation from recorded certificate and host data."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagelens.functions import fixed_values as V, scoring, text, urls
from pagelens.operators.shared import attach, even_join, first_by, unnest

# Spark's own bound for the cut before the shuffle (its default setting).
MAP_SIDE_K = 1000
CUT_SALTS = 32


def hosts_under(
    names: DataFrame, domain, order: list, keys: list | None = None
) -> DataFrame:
    """FLT-5: host names under a domain, first occurrence first.

    ``names`` has ``name``, the ``order`` columns and any further ``keys``.
    The suffix test has no dot boundary, so ``xnunoa.cl`` is under
    ``nunoa.cl``.
    """
    domain = F.lit(domain) if isinstance(domain, str) else domain
    tidy = names.withColumn("host", F.lower(text.strip(F.col("name"))))
    kept = tidy.filter(
        ~F.contains(F.col("host"), F.lit("*")) & F.endswith(F.col("host"), domain)
    )
    return first_by(kept, [*(keys or []), "host"], order, order)


def source_fallback(found: DataFrame, asked: DataFrame) -> DataFrame:
    """WIN-7: hosts of the first source that had any, per domain.

    ``found`` is ``domain, source_order, host`` with any order columns;
    ``asked`` is ``domain, source_order, answered``. The result carries
    ``answered``: an empty answer is an answer, all sources failing is not.
    """
    usable = even_join(
        found, asked.filter("answered"), ["domain", "source_order"], "left_semi"
    )
    chosen = usable.groupBy("domain").agg(F.min("source_order").alias("chosen"))
    domains = asked.groupBy("domain").agg(F.bool_or("answered").alias("answered"))
    kept = even_join(chosen, domains, "domain")
    first = even_join(usable, kept, "domain").filter(
        F.col("source_order") == F.col("chosen")
    )
    without = even_join(domains, chosen, "domain", "left_anti")
    return first.drop("chosen").unionByName(without, allowMissingColumns=True)


def live_hosts(hosts: DataFrame, probes: DataFrame) -> DataFrame:
    """FLT-11: ``https://host`` of hosts that resolved and answered below 500."""
    alive = probes.filter(
        F.col("resolved") & F.coalesce(F.col("http_status") < 500, F.lit(False))
    ).select("host")
    return even_join(hosts, alive.distinct(), "host", "left_semi").withColumn(
        "url", F.concat(F.lit("https://"), "host")
    )


def base_hosts(
    hosts: DataFrame, domains: DataFrame, order: list | None = None
) -> DataFrame:
    """SET-5: each domain's own host and ``www`` host, placed before the rest
    when missing; ``www`` ends up first. Rows are ``domain, host`` and the
    ``order`` columns, the first of which is not negative in ``hosts``."""
    order = order or ["rank"]
    extra = domains.select(
        "domain",
        F.posexplode(
            F.array(F.concat(F.lit("www."), F.col("domain")), F.col("domain"))
        ).alias("p", "host"),
    ).select(
        "domain",
        "host",
        (F.col("p") - 2).cast("bigint").alias(order[0]),
        *[F.lit(0).cast("bigint").alias(c) for c in order[1:]],
    )
    missing = even_join(
        extra, hosts.select("domain", "host"), ["domain", "host"], "left_anti"
    )
    return hosts.select(
        "domain", "host", *[F.col(c).cast("bigint").alias(c) for c in order]
    ).unionByName(missing)


def first_k(
    rows: DataFrame, keys: list, order: list, k: int, into: str | None = None
) -> DataFrame:
    """TOP-2 / TOP-3: the first ``k`` rows per key, with their rank on request.

    ``row_number <= k`` is pruned on the map side to ``k`` rows per key and
    task, so a hot key never arrives whole in one task. Spark prunes up to
    ``MAP_SIDE_K`` rows; a larger ``k`` is cut per salted key first.
    """
    if k > MAP_SIDE_K:
        mixed = [c for c, t in rows.dtypes if not t.startswith(("map", "array", "struct"))]
        salt = F.pmod(F.xxhash64(*mixed), F.lit(CUT_SALTS))
        part = Window.partitionBy(*keys, "__salt").orderBy(*order)
        rows = (
            rows.withColumn("__salt", salt)
            .withColumn("__k", F.row_number().over(part))
            .filter(F.col("__k") <= k)
            .drop("__salt", "__k")
        )
    rank = into or "__k"
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
    return kept if into else kept.drop(rank)


def search_result_urls(
    results: DataFrame, body: Column, domain, order: list, tld: str = "cl"
) -> DataFrame:
    """SRC-8: URLs under the TLD cut from saved result pages.

    A URL is kept when it mentions the domain anywhere, host or not.
    """
    domain = F.lit(domain) if isinstance(domain, str) else domain
    pattern = rf'https?://[a-zA-Z0-9.\-]+\.{tld}[^\s"<>]*'
    found = unnest(
        results.withColumn("__domain", domain),
        [*order, "__domain"],
        F.regexp_extract_all(body, F.lit(pattern), 0),
        "url",
    ).filter(F.contains(F.col("url"), F.col("__domain")))
    return first_by(found, ["url"], [*order, "pos"], [*order, "pos"])


def found_seeds(
    results: DataFrame, body: Column, order: list, tld: str = "cl", most: int = V.MAX_SEEDS
) -> DataFrame:
    """SRC-8 as seeds: ``domain, url, rank`` from saved result pages.

    ``results`` carries the ``domain`` searched for. Addresses with and without
    a closing ``/`` are one seed; the first ``most`` of a domain stay.
    """
    pattern = rf'https?://[a-zA-Z0-9.\-]+\.{tld}[^\s"<>]*'
    found = unnest(
        results, ["domain", *order], F.regexp_extract_all(body, F.lit(pattern), 0), "url"
    ).filter(F.contains(F.col("url"), F.col("domain")))
    found = found.withColumn("url", F.rtrim("url", F.lit("/")))
    first = first_by(found, ["domain", "url"], [*order, "pos"], [*order, "pos"])
    return first_k(first, ["domain"], [*order, "pos"], most, into="rank").select(
        "domain", "url", F.col("rank").cast("bigint").alias("rank")
    )


def seed_cascade(stages: list, max_seeds: int | None = None) -> DataFrame:
    """WIN-2: seeds of all stages in stage order, first occurrence kept.

    Each stage is ``domain, url, rank``. A trailing ``/`` is dropped first.
    """
    tagged = [
        s.select("domain", "url", F.col("rank").cast("bigint").alias("rank")).withColumn(
            "stage", F.lit(i)
        )
        for i, s in enumerate(stages)
    ]
    tidy = (
        reduce(DataFrame.unionByName, tagged)
        .withColumn("url", F.rtrim(F.col("url"), F.lit("/")))
        .filter(F.length("url") > 0)
    )
    seeds = first_by(tidy, ["domain", "url"], ["stage", "rank"], ["stage", "rank"])
    if max_seeds is None:
        return seeds
    return first_k(seeds, ["domain"], ["stage", "rank", "url"], max_seeds)


def merge_seed_lists(discovered: DataFrame, extra: DataFrame) -> DataFrame:
    """FLT-16: discovered seeds, then extra lines not already present."""
    return seed_cascade_flat([discovered, extra])


def seed_cascade_flat(lists: list) -> DataFrame:
    tagged = [s.select("url", "rank").withColumn("stage", F.lit(i)) for i, s in enumerate(lists)]
    tidy = reduce(DataFrame.unionByName, tagged).withColumn(
        "url", text.strip(F.col("url"))
    ).filter(F.length("url") > 0)
    return first_by(tidy, ["url"], ["stage", "rank"], ["stage", "rank"])


def with_entity(
    domains: DataFrame, municipalities: DataFrame | None = None, column: str = "domain"
) -> DataFrame:
    """JOIN-1 / SCA-28: add ``entity``; listed municipalities go first.

    The list is the user's table, one ``domain`` per row; without it the fixed
    list ``MUNICIPALITIES`` holds. Keyword rules apply to every other domain.
    """
    name = F.lower(text.strip(F.col(column)))
    if municipalities is None:
        known = F.coalesce(name.isin(V.MUNICIPALITIES), F.lit(False))
        return domains.withColumn("entity", scoring.entity(F.col(column), known))
    listed = municipalities.select(
        F.lower(text.strip(F.col("domain"))).alias("__name"), F.lit(True).alias("__listed")
    ).distinct()
    named = domains.withColumn("__name", name)
    return (
        attach(named, listed, "__name")
        .withColumn(
            "entity",
            scoring.entity(F.col(column), F.coalesce("__listed", F.lit(False))),
        )
        .drop("__name", "__listed")
    )


def query_texts(domains: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """SCA-31: search texts per domain from its type, then its live hosts.

    ``domains`` is ``domain, entity``; ``live`` is ``domain, url, rank`` and
    adds a query for the first three hosts.
    """
    templates = F.array()
    for entity, lines in reversed(V.SEARCH_QUERIES.items()):
        templates = F.when(
            F.col("entity") == entity, F.array(*[F.lit(t) for t in lines])
        ).otherwise(templates)
    filled = F.replace(
        F.replace(F.col("t"), F.lit("{domain}"), F.concat(F.lit("@"), "domain")),
        F.lit("{bare}"),
        F.col("domain"),
    )
    base = domains.select("domain", F.posexplode(templates).alias("pos", "t")).select(
        "domain", F.col("pos").cast("bigint").alias("pos"), filled.alias("query")
    )
    if live is None:
        return base
    hosts = first_k(live, ["domain"], ["rank"], V.HOSTS_QUERIED)
    return base.unionByName(
        hosts.select(
            "domain",
            (F.col("rank") + 100).cast("bigint").alias("pos"),
            F.replace(
                F.lit(V.HOST_QUERY), F.lit("{host}"), urls.authority(F.col("url"))
            ).alias("query"),
        )
    )


def domain_guesses(names: DataFrame, column: str = "comuna") -> DataFrame:
    """SCA-32: candidate domains of a place name, in pattern order."""
    patterns = F.array(*[F.lit(p) for p in V.DOMAIN_PATTERNS])
    return names.select(
        "*", F.posexplode(patterns).alias("pattern_pos", "__p")
    ).withColumn(
        "candidate",
        F.replace(F.col("__p"), F.lit("{slug}"), text.slug(F.col(column))),
    ).drop("__p")


def resolve_targets(targets: DataFrame, live: DataFrame) -> DataFrame:
    """JOIN-11: a target without a domain takes its first candidate that
    resolves (``live.host``); targets with none are dropped."""
    known = targets.filter("domain IS NOT NULL")
    guesses = domain_guesses(targets.filter("domain IS NULL").drop("domain"))
    alive = live.select(F.col("host").alias("candidate")).distinct()
    hits = guesses.join(alive, "candidate", "left_semi")
    found = hits.groupBy("comuna").agg(
        F.min_by("candidate", "pattern_pos").alias("domain")
    )
    return known.select("comuna", "domain").unionByName(found)


def select_targets(targets: DataFrame, only: DataFrame) -> tuple:
    """SRC-11: (targets named in ``only``, names of ``only`` not known)."""
    wanted = only.select(F.lower("name").alias("__n")).distinct()
    keyed = targets.withColumn("__n", F.lower("comuna"))
    chosen = keyed.join(wanted, "__n", "left_semi").drop("__n")
    unknown = wanted.join(keyed, "__n", "left_anti").withColumnRenamed("__n", "name")
    return chosen, unknown
