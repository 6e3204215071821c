"""Readers: pages, line lists, address lists and recorded observations."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagelens import schemas
from pagelens.functions import fixed_values as V, text
from pagelens.operators.shared import spread, unnest


def read_pages(
    spark: SparkSession, path: str, seq: str = "page_id", widen: bool = False
) -> DataFrame:
    """SRC-1: page snapshots with ``crawl_seq``, their order of collection.

    ``widen`` shuffles the pages of a single small file over all cores; large
    inputs have enough splits and no page text should be shuffled.
    """
    pages = spark.read.parquet(path)
    if "crawl_seq" not in pages.columns:
        pages = pages.withColumn("crawl_seq", F.col(seq).cast("bigint"))
    return spread(pages, "url") if widen else pages


def in_file_order(rows: DataFrame, into: str, *columns: str) -> DataFrame:
    """Adds ``into``, a number that grows along each file that was read.

    It is the offset of the row's split plus its place among the task's rows,
    of which there are fewer than bytes, so later splits have greater numbers.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select(
        *(columns or rows.columns),
        (F.col("_metadata.file_block_start") + place).alias(into),
    )


def named_domain(column: str | None = None) -> Column:
    """The domain of a record: its own field, else the name of its file."""
    of_file = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return of_file if column is None else F.coalesce(F.col(column), of_file)


def lines_of(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC-2: trimmed lines, blanks and ``#`` comments left out."""
    tidy = lines.withColumn(column, text.strip(F.col(column)))
    return tidy.filter((F.length(column) > 0) & ~F.col(column).startswith("#"))


def read_line_list(spark: SparkSession, path: str, column: str = "value") -> DataFrame:
    """SRC-2: one item per line in ``column``, with ``rank`` in file order.

    With ``column="url"`` the result is a seed list.
    """
    lines = in_file_order(spark.read.text(path), "rank").withColumnRenamed("value", column)
    return lines_of(lines, column)


def addresses_of(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC-3: ``email, source`` from bare addresses or tab-separated rows."""
    fields = F.split(F.col(column), "\t")
    kept = lines_of(lines, column)
    others = [c for c in lines.columns if c != column]
    return kept.select(
        *others,
        text.strip(fields[0]).alias("email"),
        F.when(F.size(fields) >= 3, text.strip(F.get(fields, F.lit(2))))
        .otherwise("")
        .alias("source"),
    ).filter(F.length("email") > 0)


def read_address_list(spark: SparkSession, path: str) -> DataFrame:
    return addresses_of(spark.read.text(path))


def packed_names(records: DataFrame, keep: list | None = None) -> DataFrame:
    """SRC-4: one ``name`` per line of ``name_value``, in record order."""
    return unnest(records, keep or [], F.split("name_value", r"\R"), "name")


def _ct_records(spark: SparkSession, path: str, schema: str, order: int, lines: bool):
    """Records with ``domain, source_order, seq`` before their own columns.

    ``lines`` reads one record a line, which splits large files; else a file is
    one array of records, as the log services answer.
    """
    found = spark.read.schema(f"domain STRING, {schema}").json(path, multiLine=not lines)
    own = [c for c in found.columns if c != "domain"]
    ordered = in_file_order(
        found.withColumn("__domain", named_domain("domain")), "seq", "__domain", *own
    )
    return ordered.select(
        F.col("__domain").alias("domain"), F.lit(order).alias("source_order"), "seq", *own
    )


_CT_KEYS = ["domain", "source_order", "seq"]


def read_ct_crtsh(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """SRC-4: ``domain, source_order, seq, pos, name`` from saved answers."""
    return packed_names(_ct_records(spark, path, schemas.CT_CRTSH, 0, lines), _CT_KEYS)


def listed_names(issuances: DataFrame, keep: list | None = None) -> DataFrame:
    """SRC-5: one ``name`` per entry of ``dns_names``; a missing list has none."""
    names = F.coalesce("dns_names", F.array().cast("array<string>"))
    return unnest(issuances, keep or [], names, "name")


def read_ct_certspotter(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """SRC-5: ``domain, source_order, seq, pos, name`` from saved answers."""
    return listed_names(
        _ct_records(spark, path, schemas.CT_CERTSPOTTER, 1, lines), _CT_KEYS
    )


def read_ct_asked(spark: SparkSession, path: str, source_order: int) -> DataFrame:
    """``domain, source_order, answered``: a saved answer, even an empty one."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        named_domain().alias("domain"),
        F.lit(source_order).alias("source_order"),
        F.lit(True).alias("answered"),
    )


def read_doh_answers(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: ``domain, answer`` rows, the answer kept as JSON text."""
    return spark.read.schema("domain STRING, answer STRING").json(path)


def suffix_rules(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC-7: public-suffix rules, comments and blanks left out."""
    rule = text.strip(F.col(column))
    return lines.filter(
        (F.length(rule) > 0) & ~F.col(column).startswith("//")
    ).select(rule.alias("suffix"))


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    return suffix_rules(spark.read.text(path))


def _under_domain(address: Column, domain: Column) -> Column:
    """The address up to the last place where its host ends with the domain.

    A label boundary stands before the domain and no letter, digit or
    underscore after it; NULL where there is no such place.
    """
    host = F.concat(F.lit("."), F.substring_index(address, "@", -1))
    turned, wanted = F.reverse(host), F.reverse(F.concat(F.lit("."), domain))
    at = F.instr(turned, wanted)
    after = F.substring(turned, at - 1, F.lit(1))
    kept = F.reverse(F.substring(turned, at, F.length(turned)))
    fits = (at == 1) | ((at > 1) & after.isin(".", "-"))
    return F.when(
        fits,
        F.concat(F.substring_index(address, "@", 1), F.lit("@"), F.substring(kept, F.lit(2), F.length(kept))),
    )


def keyserver_rows(index_pages: DataFrame) -> DataFrame:
    """SRC-10: ``domain, server, outcome, count, addresses`` per saved page.

    Input is ``domain, server, status, body``. Only addresses under the
    page's own domain count. Status 404 means asked and none, 200 means
    answered; anything else is a non-response. One pattern finds the addresses
    of every page; their host is then compared with the page's domain.
    """
    local = V.LOCAL_CHARS
    pattern = rf"(?U)(?:(?<!{local})|\G){local}++@[a-zA-Z0-9.\-]++(?![\w@])"
    ok = F.col("status") == 200
    domain = F.lower("domain")
    under = F.transform(
        F.regexp_extract_all("body", F.lit(pattern), 0),
        lambda a: _under_domain(F.lower(a), domain),
    )
    found = F.when(ok, F.array_sort(F.array_distinct(F.array_compact(under)))).otherwise(
        F.array().cast("array<string>")
    )
    rows = index_pages.withColumn("__found", found)
    keep = [c for c in index_pages.columns if c not in ("status", "body")]
    return rows.select(
        *keep,
        F.when(ok, "ok")
        .when(F.col("status") == 404, "none")
        .when(F.col("status").isNull(), "error")
        .otherwise(F.concat(F.lit("http "), F.col("status").cast("string")))
        .alias("outcome"),
        F.size("__found").alias("count"),
        F.array_join("__found", " ").alias("addresses"),
    )


def _path_names(count: int) -> Column:
    """The last ``count`` names of a file's path, as they were written.

    The file's extension goes, and so does ``key=`` before a folder's name.
    """
    kept = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    names = F.slice(F.split(kept, "/"), -count, count)

    def tidy(name: Column, i: Column) -> Column:
        bare = F.when(i == count - 1, F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")).otherwise(name)
        bare = F.regexp_replace(bare, r"^\w+=", "")
        return F.coalesce(F.try_url_decode(bare), bare)

    return F.transform(names, tidy)


def _body_text(content: Column) -> Column:
    """UTF-8, or where it is not, Latin-1; every byte has a meaning there."""
    unmarked = F.regexp_replace(content.cast("string"), "^\ufeff", "")
    return F.when(F.is_valid_utf8(content.cast("string")), unmarked).otherwise(
        F.decode(content, "ISO-8859-1")
    )


def read_saved_pages(
    spark: SparkSession, path: str, names: list, pattern: str | None = None
) -> DataFrame:
    """One row a file: ``names`` from its path, ``status`` and ``body``.

    ``names`` are the last parts of the path, the last being the file's name
    without its extension (``["server", "domain"]`` for
    ``pgp.example/nunoa.cl.html``; ``server=pgp.example`` is the same). A part
    that says nothing is named None (files that Spark wrote below folders). A saved
    response may begin with its status line and headers, and those of
    redirects before it: the last status counts. A file without them was
    answered with 200; a blank file is a request without an answer, status
    NULL (it needs a line end: Spark leaves out files without a byte). Many small files share a task; a file is one row.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    raw = F.col("__raw")
    head = r"(?s)\A(?:HTTP/[0-9.]++ ++[0-9]{3}\b(?:(?!\r?\n\r?\n).)*+\r?\n\r?\n)*HTTP/[0-9.]++ ++([0-9]{3})\b(?:(?!\r?\n\r?\n).)*+(?:\r?\n\r?\n|\z)"
    status = F.regexp_extract(raw, head, 1)
    found = reader.load(path).select(
        _path_names(len(names)).alias("__names"),
        _body_text(F.col("content")).alias("__raw"),
    )
    return found.select(
        *[F.get("__names", F.lit(i)).alias(n) for i, n in enumerate(names) if n],
        F.when(F.rlike(raw, F.lit(r"\S")), F.coalesce(status.try_cast("int"), F.lit(200))).alias("status"),
        F.regexp_replace(raw, head, "").alias("body"),
    )


def read_saved_searches(
    spark: SparkSession, path: str, names: tuple = ("domain", "k")
) -> DataFrame:
    """SRC-8: ``domain, k, body`` from files ``<domain>/<k>.<extension>``.

    ``k`` is the place of a page in the search, as a number. Pages that were
    not answered with 200 hold no results and are left out.
    """
    saved = read_saved_pages(spark, path, list(names))
    return saved.filter(F.col("status") == 200).select(
        F.lower("domain").alias("domain"),
        F.coalesce(F.col("k").try_cast("bigint"), F.lit(0)).alias("k"),
        "body",
    )


def read_keyserver_pages(
    spark: SparkSession, path: str, names: tuple = ("server", "domain")
) -> DataFrame:
    """SRC-10: ``domain, server, status, body`` from ``<server>/<domain>.<ext>``."""
    saved = read_saved_pages(spark, path, list(names))
    return saved.select(F.lower("domain").alias("domain"), "server", "status", "body")


def target_list(spark: SparkSession) -> DataFrame:
    """SRC-11: ``comuna, domain`` of the regional target list."""
    return spark.createDataFrame(V.TARGETS, "comuna STRING, domain STRING")
