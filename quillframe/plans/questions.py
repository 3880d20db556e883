"""The query surface: registering, paging, profiling, names, and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import text as tx
from quillframe.operators import query as sql
from quillframe.operators import search, sinks
from quillframe.operators.query import LOG_BUCKETS, RANK_K, column_sketches, profile_of_sketches
from quillframe.operators.search_index import build_index
from quillframe.plans import render
from quillframe.plans.catalogue import query, table, workspace
from quillframe.plans.extraction import order_records
from quillframe.session import materialise, scratch_path
from quillframe.sources import listing


@query(
    """
SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS orders, max(o_totalprice) AS highest
FROM orders GROUP BY o_orderstatus
"""
)
def register_and_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = workspace(spark, sf_dir, "orders")
    ws.register_table("orders", f"{sf_dir}/orders.parquet")  # replaces itself
    return ws.query(
        "SELECT o_orderstatus, count(*) AS orders, max(o_totalprice) AS highest "
        "FROM orders GROUP BY o_orderstatus;"
    )


_ORDERED = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"


@query(f"SELECT * FROM ({_ORDERED}) LIMIT 1000")
def page_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir, "orders").page(_ORDERED)


@query(f"SELECT * FROM ({_ORDERED}) LIMIT 1000 OFFSET 1000")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir, "orders").page(_ORDERED, 1000, 1000)


@query(
    f"""
SELECT page, CAST(count(*) AS BIGINT) AS rows, min(o_totalprice) AS lowest, max(o_totalprice) AS highest FROM (
  SELECT CAST((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) // 5000 AS BIGINT) AS page, o_totalprice
  FROM ({_ORDERED}))
GROUP BY page
"""
)
def page_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a result that is computed once."""
    pages = workspace(spark, sf_dir, "orders").cursor(_ORDERED).pages(5000)
    return pages.numbered().groupBy("page").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("o_totalprice").alias("lowest"),
        F.max("o_totalprice").alias("highest"),
    )


_SKETCHED = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_linestatus": "string",
}


def _exact(items: DataFrame, column: str, median: float | None) -> DataFrame:
    """One row: distinct values of a column, and values below and up to the median."""
    values = items.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("long")
    m = F.lit(median).cast("double")
    number = F.col("v").cast("double") if median is not None else F.lit(None).cast("double")
    return values.agg(
        F.lit(column).alias("column_name"),
        F.count("v").alias("distinct"),
        F.coalesce(F.sum(F.when(number < m, F.col("n"))), none).alias("below"),
        F.coalesce(F.sum(F.when(number <= m, F.col("n"))), none).alias("up_to"),
    )


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS column_type, count(*) AS rows, count({c}) AS non_null, "
        f"true AS distinct_fits, {'true' if t != 'string' else 'CAST(NULL AS BOOLEAN)'} AS median_fits FROM lineitem"
        for c, t in _SKETCHED.items()
    )
)
def profile_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of lineitem profiled by sketches of each return flag, and whether the
    estimates lie within their bounds around the exact values."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", *_SKETCHED)
    sketches = materialise(column_sketches(items, ["l_returnflag"]), "sketches")
    found = materialise(profile_of_sketches(sketches), "sketch-profile")
    rows = {r.column_name: r for r in found.collect()}  # one per column
    # each column by itself, as distinct values with their counts: no row is multiplied
    exact = [
        _exact(items, c, None if t == "string" else rows[c].median_value)
        for c, t in _SKETCHED.items()
    ]
    truth = {r.column_name: r for r in reduce(DataFrame.unionByName, exact).collect()}  # one per column

    def fits(c: str) -> tuple[str, bool, bool | None]:
        bound = 4 * 1.04 / 2 ** (LOG_BUCKETS / 2)
        near = abs(rows[c].distinct_values - truth[c].distinct) <= bound * truth[c].distinct + 1
        if _SKETCHED[c] == "string":
            return c, near, None
        n, error = rows[c].non_null, 2.3 / RANK_K
        return c, near, truth[c].below - 1 <= (0.5 + error) * n and truth[c].up_to + 1 >= (0.5 - error) * n

    verdict = spark.createDataFrame(
        [fits(c) for c in _SKETCHED], "column_name string, distinct_fits boolean, median_fits boolean"
    )
    return found.join(verdict, "column_name").select(
        "column_name", "column_type", "rows", "non_null", "distinct_fits", "median_fits"
    )


#: Steps in which the longest chain of orders ends, and the most orders of one step.
CHAIN_STEPS = 8
CHAIN_RUN = 1_000_000


@query(
    """
WITH RECURSIVE ranked AS (
  SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders
), chain AS (
  SELECT o_custkey, n, o_totalprice AS best, 1 AS highs FROM ranked WHERE n = 1
  UNION ALL
  SELECT r.o_custkey, r.n, greatest(c.best, r.o_totalprice), c.highs + CASE WHEN r.o_totalprice > c.best THEN 1 ELSE 0 END
  FROM chain c JOIN ranked r ON r.o_custkey = c.o_custkey AND r.n = c.n + 1
)
SELECT o_custkey, CAST(max(n) AS BIGINT) AS orders, max(best) AS best, CAST(max(highs) AS BIGINT) AS highs
FROM chain GROUP BY o_custkey
"""
)
def cte_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders one after the other: how often one beat all before it.

    A step of the recursion takes a run of a customer's orders, as long as it must be
    for the longest chain to end in CHAIN_STEPS steps. Orders without a customer follow
    no other, so only the first of them is there.
    """
    ws = workspace(spark, sf_dir, "orders")
    # stored, as every step of the recursion reads it
    ranked = ws.query(
        "SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders"
    )
    materialise(ranked, "ranked-orders").createOrReplaceTempView("ranked")
    longest = ws.query("SELECT max(n) FROM ranked WHERE o_custkey IS NOT NULL OR n = 1").first()[0] or 1
    length = min(-(-longest // CHAIN_STEPS), CHAIN_RUN)
    runs = ws.query(
        f"""
SELECT o_custkey, run, transform(array_sort(collect_list(struct(n, o_totalprice))), o -> o.o_totalprice) AS prices
FROM (SELECT *, (n - 1) DIV {length} AS run FROM ranked WHERE o_custkey IS NOT NULL OR n = 1)
GROUP BY o_custkey, run
"""
    )
    materialise(runs, "order-runs").createOrReplaceTempView("runs")
    ws.allow_recursion(-(-longest // length))
    beaten = """(s, price) -> named_struct(
      'best', greatest(s.best, price), 'highs', s.highs + CASE WHEN price > s.best THEN 1 ELSE 0 END)"""
    return ws.query(
        f"""
WITH RECURSIVE chain AS (
  SELECT o_custkey, run, size(prices) AS n,
         aggregate(slice(prices, 2, size(prices)), named_struct('best', prices[0], 'highs', 1), {beaten}) AS s
  FROM runs WHERE run = 0
  UNION ALL
  SELECT r.o_custkey, r.run, c.n + size(r.prices), aggregate(r.prices, c.s, {beaten})
  FROM chain c JOIN runs r ON r.o_custkey = c.o_custkey AND r.run = c.run + 1
)
SELECT o_custkey, CAST(max(n) AS BIGINT) AS orders, max(s.best) AS best, CAST(max(s.highs) AS BIGINT) AS highs
FROM chain GROUP BY o_custkey
"""
    )


_TOTALS = "SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey"


@query(
    f"""
SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(0 AS BIGINT) AS page_rows
FROM ({_TOTALS})
"""
)
def page_past_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page behind the last row is empty; the total stays what it is."""
    ws = workspace(spark, sf_dir, "orders")
    ordered = f"{_TOTALS} ORDER BY o_custkey"
    end = ws.total(_TOTALS).first().total_rows
    result = ws.execute_sql(ordered, limit=1000, offset=end)
    page_rows = F.lit(len(result.rows)).cast("long")
    return ws.total(_TOTALS).withColumn("page_rows", page_rows)


@query(
    """
SELECT CAST(count(*) AS BIGINT) AS total_rows FROM
  (SELECT l_orderkey, l_linenumber, sum(l_quantity) FROM lineitem GROUP BY ALL)
"""
)
def page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir, "lineitem").total(
        "SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q "
        "FROM lineitem GROUP BY l_orderkey, l_linenumber"
    )


def _profile_sql(*columns: tuple[str, str, str]) -> str:
    parts = []
    for name, kind, mean in columns:
        lo, hi = (f"{f}({name})" for f in ("min", "max"))
        if kind.startswith("timestamp"):
            lo, hi = (f"strftime({x}, '%Y-%m-%d %H:%M:%S')" for x in (lo, hi))
        parts.append(
            f"SELECT '{name}' AS column_name, '{kind}' AS column_type, "
            f"CAST(count({name}) AS BIGINT) AS non_null, "
            f"CAST(count(DISTINCT {name}) AS BIGINT) AS distinct_values, "
            f"CAST({lo} AS VARCHAR) AS min_value, CAST({hi} AS VARCHAR) AS max_value, "
            f"{mean} AS mean_value FROM orders"
        )
    return "\nUNION ALL\n".join(parts)


@query(
    _profile_sql(
        ("o_orderkey", "bigint", "round(avg(o_orderkey), 4)"),
        ("o_custkey", "bigint", "round(avg(o_custkey), 4)"),
        ("o_orderstatus", "string", "CAST(NULL AS DOUBLE)"),
        ("o_totalprice", "double", "round(avg(o_totalprice), 4)"),
        ("o_orderdate", "timestamp_ntz", "CAST(NULL AS DOUBLE)"),
        ("o_orderpriority", "string", "CAST(NULL AS DOUBLE)"),
    )
)
def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = sql.profile_table(table(spark, sf_dir, "orders"))
    return profile.withColumn("mean_value", F.round("mean_value", 4))


@query(
    r"""
WITH named AS (
  SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN '/data/' || p_brand || '/' || p_name || ' (2024).csv'
                  WHEN 'SMALL' THEN CAST(p_size AS VARCHAR)
                  WHEN 'LARGE' THEN '--'
                  ELSE '  ' || p_name || '__' || p_brand || '!' END AS raw
  FROM part
), based AS (
  SELECT p_partkey, CASE WHEN contains(raw, '/') THEN string_split(raw, '/')[-1] ELSE raw END AS base FROM named
), body AS (
  SELECT p_partkey, trim(regexp_replace(lower(base), '[^a-z0-9]+', '_', 'g'), '_') AS b FROM based
), safe AS (
  SELECT p_partkey, CASE WHEN regexp_matches(b, '^[a-z]') THEN b ELSE 't_' || b END AS s FROM body
)
SELECT p_partkey, CASE WHEN length(s) > 2 THEN s ELSE 'dataset' END AS table_name FROM safe
"""
)
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = (
        F.when(
            F.col("p_type") == "PROMO",
            F.concat(F.lit("/data/"), "p_brand", F.lit("/"), "p_name", F.lit(" (2024).csv")),
        )
        .when(F.col("p_type") == "SMALL", F.col("p_size").cast("string"))
        .when(F.col("p_type") == "LARGE", F.lit("--"))
        .otherwise(F.concat(F.lit("  "), "p_name", F.lit("__"), "p_brand", F.lit("!")))
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", tx.table_name(raw).alias("table_name")
    )


# -- search ---------------------------------------------------------------------------

_PATTERN = "[a-z0-9._-]+@[a-z0-9.-]+"
_LINES = """
cut AS (SELECT doc_id, source, regexp_split_to_array(text, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS p FROM documents),
lines AS (
  SELECT doc_id, source, i AS line_no, p[i] AS line,
         'doc_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.txt' AS name
  FROM cut, unnest(range(1, len(p) + CASE WHEN p[-1] = '' THEN 0 ELSE 1 END)) AS t(i)
)
"""


@query(
    f"""
WITH {_LINES}
SELECT 'source' AS origin, name, CAST(line_no AS BIGINT) AS line_no,
       left(trim(line, ' ' || chr(9)), 120) AS line
FROM lines WHERE regexp_matches(line, '{_PATTERN}', 'i')
ORDER BY name, line_no LIMIT 20
"""
)
def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matches in path and line order, the feature's default count."""
    return search.search(render.text_documents(spark, sf_dir), _PATTERN)


@query(
    f"""
WITH {_LINES}
SELECT regexp_replace(name, '[.]txt$', '') AS name, CAST(line_no AS BIGINT) AS line_no,
       trim(line, ' ' || chr(9)) AS line
FROM lines WHERE regexp_matches(line, '{_PATTERN}', 'i')
"""
)
def search_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches in files of all extensions, also such that no parser takes, with
    a byte that is not UTF-8 in front of each."""
    files = render.text_files(spark, sf_dir).withColumn(
        "content", F.concat("content", F.lit(b"\n\xff"))
    )
    found = search.matching_file_lines(files, _PATTERN)
    return found.select(F.regexp_extract("name", r"^(\w+)\.", 1).alias("name"), "line_no", "line")


#: Text of a block of the index: the test tables are small, and so are their blocks.
_INDEX_BLOCK = 1 << 17
_INDEXED = (_PATTERN, "MENTRE+a|thaner[a-z]+", "^[^.,]+$")


@query(
    f"WITH {_LINES}\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{p}' AS pattern, regexp_replace(name, '[.]txt$', '') AS name, CAST(line_no AS BIGINT) AS line_no, "
        f"trim(line, ' ' || chr(9)) AS line FROM lines WHERE regexp_matches(line, '{p}', 'i')"
        for p in _INDEXED
    )
)
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found through an index over all documents: by a sign, by runs of two
    alternatives, and by a scan, as the third pattern has nothing to look up."""
    index = build_index(render.text_documents(spark, sf_dir), scratch_path(spark, "index"), _INDEX_BLOCK)
    found = [index.matching_lines(p).select(F.lit(p).alias("pattern"), "*") for p in _INDEXED]
    return reduce(DataFrame.unionByName, found).select(
        "pattern", F.regexp_extract("name", r"^(\w+)\.", 1).alias("name"), "line_no", "line"
    )


@query(
    f"""
WITH {_LINES}
SELECT source, CAST(count(*) AS BIGINT) AS matches, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents
FROM lines WHERE regexp_matches(line, 'THE|[. ]EIN', 'i') GROUP BY source
"""
)
def search_count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.text_documents(spark, sf_dir)
    # the source rides along as the name of the file
    found = search.matching_lines(
        docs.withColumns({"path": F.col("document_id"), "filename": F.col("source")}),
        "THE|[. ]EIN",
    )
    # one row per document before sources are counted: no hot source group
    per_document = found.groupBy("name", "path").agg(F.count(F.lit(1)).alias("n"))
    return per_document.groupBy(F.col("name").alias("source")).agg(
        F.sum("n").alias("matches"), F.count(F.lit(1)).alias("documents")
    )


@query(
    f"""
WITH {render.ORDER_TRUTH}, {_LINES}, dump AS (
  SELECT row_number() OVER (ORDER BY doc_index) AS record_no, * FROM truth
), kept AS (
  SELECT *, (row_number() OVER (ORDER BY record_no) - 1) * 10 AS before_it
  FROM dump WHERE NOT (no_total OR bad_total)
), found AS (
  (SELECT 0 AS rank, 'source' AS origin, name, line_no, left(trim(line, ' ' || chr(9)), 120) AS line
   FROM lines WHERE contains(line, '@') ORDER BY name, line_no LIMIT 40)
  UNION ALL
  SELECT 1, 'extracted', 'data.txt', before_it + 8, 'urgent: True' FROM kept WHERE urgent
)
SELECT origin, name, CAST(line_no AS BIGINT) AS line_no, line
FROM found ORDER BY rank, name, line_no LIMIT 40
"""
)
def search_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that hold an address, then lines of the extracted dump
    for what is left of the places."""
    records = materialise(order_records(spark, sf_dir), "records")
    dump = sinks.dump_lines(records, render.ORDER_SCHEMA)
    lines = listing.lines(render.text_documents(spark, sf_dir), "path", "filename")
    return search.search_all(lines, dump, "@|^urgent: true", max_results=40)


@query(
    f"""
WITH {_LINES}
SELECT source, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars,
       CAST(max(line_no) AS BIGINT) AS longest
FROM lines GROUP BY source
"""
)
def count_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing.lines(render.text_documents(spark, sf_dir), "source")
    return found.groupBy("source").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.length("line")).alias("chars"),
        F.max("line_no").cast("long").alias("longest"),
    )
