"""SQL operator classes, as queries over registered tables.

Sums of money run on decimals, which makes them exact whatever the order of
the rows. Joins to a fact table are done after it has been aggregated to the
join key wherever the result allows it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators import ordered, relational
from quillframe.operators.contracts import compute_once
from quillframe.plans import render
from quillframe.plans.catalogue import query, table, workspace
from quillframe.session import materialise

_REVENUE = (
    # 18 digits in all, which Spark keeps in a long
    "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
)


@query(
    """
SELECT p_partkey, p_name AS part_name, p_retailprice * 2 AS doubled,
       p_size + 1 AS next_size, p_brand || ' / ' || p_type AS label, p_size > 25 AS is_large
FROM part
"""
)
def project_exprs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir, "part").query(
        'SELECT p_partkey, p_name AS "part_name", p_retailprice * 2 AS doubled, '
        "p_size + 1 AS next_size, p_brand || ' / ' || p_type AS label, "
        "p_size > 25 AS is_large FROM part"
    )


@query(
    """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderstatus IN ('O', 'P') AND o_totalprice BETWEEN 1000 AND 200000
  AND o_orderpriority LIKE '%-H%' AND lower(o_orderpriority) LIKE '%high'
  AND o_orderdate IS NOT NULL AND regexp_matches(o_orderpriority, '^[0-9]-')
  AND o_orderdate >= TIMESTAMP '1996-01-01' AND NOT (o_custkey = 7)
"""
)
def filter_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir, "orders").query(
        """
        SELECT o_orderkey, o_totalprice FROM orders
        WHERE o_orderstatus IN ('O', 'P') AND o_totalprice BETWEEN 1000 AND 200000
          AND o_orderpriority LIKE '%-H%' AND o_orderpriority ILIKE '%high'
          AND o_orderdate IS NOT NULL AND o_orderpriority RLIKE '^[0-9]-'
          AND o_orderdate >= TIMESTAMP_NTZ '1996-01-01' AND NOT (o_custkey = 7)
        """
    )


@query(
    f"""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity,
       CAST(sum({_REVENUE}) AS DOUBLE) AS revenue, min(l_extendedprice) AS lowest,
       max(l_extendedprice) AS highest, CAST(sum(l_quantity) AS DOUBLE) / count(*) AS mean_quantity
FROM lineitem
"""
)
def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir, "lineitem").query(
        f"""
        SELECT count(*) AS n, sum(l_quantity) AS quantity,
               CAST(sum({_REVENUE}) AS DOUBLE) AS revenue, min(l_extendedprice) AS lowest,
               max(l_extendedprice) AS highest, sum(l_quantity) / count(*) AS mean_quantity
        FROM lineitem
        """
    )


@query(
    f"""
SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(l_quantity) AS DOUBLE) AS sum_qty,
       CAST(sum({_REVENUE}) AS DOUBLE) AS revenue,
       CAST(sum(l_quantity) AS DOUBLE) / count(*) AS mean_qty
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02'
GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10
"""
)
def agg_group_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir, "lineitem").query(
        f"""
        SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty,
               CAST(sum({_REVENUE}) AS DOUBLE) AS revenue,
               sum(l_quantity) / count(*) AS mean_qty
        FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '2001-09-02'
        GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10
        """
    )


_TOPK = (
    "SELECT o_orderkey, o_totalprice FROM orders "
    "ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25"
)


@query(_TOPK)
def topk_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir, "orders").query(_TOPK)


@query(
    f"""
SELECT r_name, CAST(year(o_orderdate) AS BIGINT) AS order_year,
       CAST(sum({_REVENUE}) AS DOUBLE) AS revenue, CAST(count(*) AS BIGINT) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL
"""
)
def join_inner_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items are reduced to orders, orders to customers, before joining:
    no join input has more than one row per key and year."""
    ws = workspace(spark, sf_dir, "lineitem", "orders", "customer", "nation", "region")
    return ws.query(
        f"""
        WITH by_order AS (
          SELECT l_orderkey, sum({_REVENUE}) AS revenue, count(*) AS n
          FROM lineitem GROUP BY l_orderkey
        ), by_customer AS (
          SELECT o_custkey, year(o_orderdate) AS order_year,
                 sum(revenue) AS revenue, sum(n) AS n
          FROM by_order JOIN orders ON l_orderkey = o_orderkey
          GROUP BY o_custkey, year(o_orderdate)
        )
        SELECT r_name, CAST(order_year AS BIGINT) AS order_year,
               CAST(sum(revenue) AS DOUBLE) AS revenue, sum(n) AS lines
        FROM by_customer JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey
        GROUP BY r_name, order_year
        """
    )


@query(
    """
SELECT c_custkey, c_mktsegment, CAST(count(o_orderkey) AS BIGINT) AS orders,
       max(o_totalprice) AS highest
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment
"""
)
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("highest")
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left").select(
        "c_custkey",
        "c_mktsegment",
        F.coalesce("orders", F.lit(0).cast("long")).alias("orders"),
        "highest",
    )


@query(
    """
SELECT coalesce(o_custkey, user_id) AS person, CAST(coalesce(orders, 0) AS BIGINT) AS orders,
       CAST(coalesce(events, 0) AS BIGINT) AS events
FROM (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey)
FULL JOIN (SELECT user_id, count(*) AS events FROM events GROUP BY user_id) ON o_custkey = user_id
"""
)
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides reduced to unique keys first: a full join cannot be split
    by key at run time."""
    return workspace(spark, sf_dir, "orders", "events").query(
        """
        WITH o AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey),
             e AS (SELECT user_id, count(*) AS events FROM events GROUP BY user_id)
        SELECT coalesce(o_custkey, user_id) AS person, coalesce(orders, 0) AS orders,
               coalesce(events, 0) AS events
        FROM o FULL JOIN e ON o_custkey = user_id
        """
    )


@query(
    """
SELECT c_custkey, c_name FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
"""
)
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = (
        table(spark, sf_dir, "orders")
        .filter("o_orderpriority = '1-URGENT'")
        .select("o_custkey")
        .distinct()
    )
    customer = table(spark, sf_dir, "customer")
    return customer.join(
        urgent, customer.c_custkey == urgent.o_custkey, "left_semi"
    ).select("c_custkey", "c_name")


@query(
    """
SELECT p_partkey, p_name FROM part
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R'
                  AND l_quantity > 45)
"""
)
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = (
        table(spark, sf_dir, "lineitem")
        .filter("l_returnflag = 'R' AND l_quantity > 45")
        .select("l_partkey")
        .distinct()
    )
    part = table(spark, sf_dir, "part")
    return part.join(returned, part.p_partkey == returned.l_partkey, "left_anti").select(
        "p_partkey", "p_name"
    )


@query(
    """
WITH quarters AS (
  SELECT date_trunc('quarter', o_orderdate) AS q, count(*) AS orders FROM orders GROUP BY 1
)
SELECT strftime(q, '%Y-%m-%d') AS quarter_start, CAST(orders AS BIGINT) AS orders,
       CAST(count(*) AS BIGINT) AS shipped, CAST(sum(l_quantity) AS DOUBLE) AS quantity
FROM quarters JOIN lineitem ON l_shipdate >= q AND l_shipdate < q + INTERVAL 3 MONTH
GROUP BY ALL
"""
)
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments within order quarters; shipments are reduced to days first."""
    quarters = (
        table(spark, sf_dir, "orders")
        .groupBy(F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")).alias("q"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .withColumn("q_end", F.col("q") + F.expr("INTERVAL 3 MONTH"))
    )
    days = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_shipdate").cast("timestamp").alias("shipped_on"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    )
    joined = relational.interval_join(days, quarters, "shipped_on", "q", "q_end", "month")
    return joined.groupBy(
        F.date_format("q", "yyyy-MM-dd").alias("quarter_start"), "orders"
    ).agg(F.sum("n").alias("shipped"), F.sum("quantity").alias("quantity"))


_CALENDAR = """
SELECT DISTINCT unit, q AS begins, CASE unit WHEN 'month' THEN q + INTERVAL 1 MONTH
  WHEN 'quarter' THEN q + INTERVAL 3 MONTH ELSE q + INTERVAL 1 YEAR END AS ends
FROM (SELECT unit, date_trunc(unit, o_orderdate) AS q FROM orders, (VALUES ('month'), ('quarter'), ('year')) u(unit))
"""


def _order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from their date to the day after the last shipment."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey",
        "o_custkey",
        F.col("o_orderdate").cast("timestamp").alias("opened"),
        (F.col("last").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("closed"),
    )


_OPEN_SPANS = """
spans AS (
  SELECT o_orderkey, o_custkey, o_orderdate AS opened, max(l_shipdate) + INTERVAL 1 DAY AS closed
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
)"""


@query(
    f"""
WITH {_OPEN_SPANS}, calendar AS ({_CALENDAR})
SELECT unit, strftime(begins, '%Y-%m-%d') AS begins, CAST(count(*) AS BIGINT) AS open_orders
FROM calendar JOIN spans ON opened < ends AND begins < closed
WHERE opened < closed GROUP BY ALL
"""
)
def join_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders open at some time of each month, quarter and year: spans of any length."""
    calendar = reduce(
        DataFrame.unionByName,
        [
            table(spark, sf_dir, "orders")
            .select(F.lit(unit).alias("unit"), F.date_trunc(unit, F.col("o_orderdate").cast("timestamp")).alias("begins"))
            .distinct()
            .withColumn("ends", F.col("begins") + F.expr(f"INTERVAL {step}"))
            for unit, step in (("month", "1 MONTH"), ("quarter", "3 MONTH"), ("year", "1 YEAR"))
        ],
    )
    found = relational.overlap_join(_order_spans(spark, sf_dir), calendar, ("opened", "closed"), ("begins", "ends"))
    return found.groupBy("unit", F.date_format("begins", "yyyy-MM-dd").alias("begins")).agg(
        F.count(F.lit(1)).alias("open_orders")
    )


@query(
    f"""
WITH {_OPEN_SPANS}
SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS other FROM spans a JOIN spans b
  ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.opened < b.closed AND b.opened < a.closed
WHERE a.opened < a.closed AND b.opened < b.closed
"""
)
def join_overlap_same_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's orders that were open at the same time."""
    spans = _order_spans(spark, sf_dir)
    other = spans.select(
        "o_custkey", F.col("o_orderkey").alias("other"), F.col("opened").alias("begins"), F.col("closed").alias("ends")
    )
    found = relational.overlap_join(spans, other, ("opened", "closed"), ("begins", "ends"), ["o_custkey"])
    return found.where("o_orderkey < other").select("o_custkey", "o_orderkey", "other")


@query(
    """
WITH buys AS (SELECT * FROM events WHERE event_type = 'purchase'),
     views AS (SELECT * FROM events WHERE event_type = 'view')
SELECT b.event_id, b.user_id, v.event_id AS view_id, v.value AS view_value
FROM buys b ASOF LEFT JOIN views v ON b.user_id = v.user_id AND b.ts >= v.ts
"""
)
def join_asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase with the user's last view before it."""
    events = table(spark, sf_dir, "events")
    views = events.filter("event_type = 'view'").select(
        "user_id", "ts", "event_id", F.col("event_id").alias("view_id"),
        F.col("value").alias("view_value"),
    )
    buys = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return ordered.asof_join(
        buys, views, ["user_id"], ["ts", "event_id"], ["view_id", "view_value"]
    ).drop("ts")


@query(
    """
SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS distinct_l_partkey,
       CAST(count(DISTINCT l_suppkey) AS BIGINT) AS distinct_l_suppkey, true AS sketch_is_close
FROM lineitem GROUP BY l_returnflag
"""
)
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts, and whether the sketch is within a tenth of them."""
    lines = table(spark, sf_dir, "lineitem")
    keys, columns = ["l_returnflag"], ["l_partkey", "l_suppkey"]
    exact = relational.distinct_counts(lines, keys, columns)
    sketch = relational.distinct_counts(lines, keys, ["l_partkey"], exact=False)
    sketch = sketch.withColumnRenamed("distinct_l_partkey", "_sketch")
    gap = F.abs(F.col("_sketch") - F.col("distinct_l_partkey"))
    return (
        exact.join(sketch, keys)
        .withColumn("sketch_is_close", gap <= F.col("distinct_l_partkey") * 0.1)
        .drop("_sketch")
    )


def _grouped(kind: str) -> str:
    return f"""
SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INTEGER) AS g_status,
       CAST(grouping(o_orderpriority) AS INTEGER) AS g_priority, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY {kind}
"""


@query(_grouped("ROLLUP (o_orderstatus, o_orderpriority)"))
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir, "orders").query(
        _grouped("ROLLUP (o_orderstatus, o_orderpriority)")
    )


@query(_grouped("CUBE (o_orderstatus, o_orderpriority)"))
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir, "orders").query(
        _grouped("CUBE (o_orderstatus, o_orderpriority)")
    )


@query(_grouped("GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"))
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir, "orders").query(
        _grouped("GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
    )


@query(
    """
SELECT l_returnflag, median(l_quantity) AS median_qty,
       quantile_cont(l_quantity, 0.9) AS p90_qty, quantile_cont(l_tax, 0.25) AS p25_tax,
       round(stddev_samp(l_quantity), 6) AS sd_qty, round(var_pop(l_discount), 6) AS var_discount,
       round(corr(l_quantity, l_extendedprice), 6) AS corr_qty_price
FROM lineitem GROUP BY l_returnflag
"""
)
def agg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    key = ["l_returnflag"]
    quantity = relational.quantiles(
        lines, key, "l_quantity", [0.5, 0.9], ["median_qty", "p90_qty"]
    )
    tax = relational.quantiles(lines, key, "l_tax", [0.25], ["p25_tax"])
    moments = lines.groupBy(*key).agg(
        F.round(F.stddev("l_quantity"), 6).alias("sd_qty"),
        F.round(F.var_pop("l_discount"), 6).alias("var_discount"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr_qty_price"),
    )
    return quantity.join(tax, key).join(moments, key)


@query(
    """
SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS BIGINT) AS position,
       CAST(rank() OVER p AS BIGINT) AS price_rank, CAST(dense_rank() OVER p AS BIGINT) AS price_dense_rank
FROM (SELECT *, floor(o_totalprice / 10000) AS band FROM orders)
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
       p AS (PARTITION BY o_custkey ORDER BY band DESC)
"""
)
def win_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderkey",
        "o_orderdate",
        F.floor(F.col("o_totalprice") / 10000).alias("band"),
    )
    placed = ordered.row_numbers(
        orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "position"
    )
    ranked = ordered.ranks(placed, ["o_custkey"], "band", descending=True)
    return ranked.select(
        "o_custkey",
        "o_orderkey",
        "position",
        F.col("rank").cast("long").alias("price_rank"),
        F.col("dense_rank").cast("long").alias("price_dense_rank"),
    )


_MIXED = """
SELECT o_orderkey, o_orderstatus, NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS priority,
       CASE WHEN o_totalprice < 200000 THEN floor(o_totalprice / 1000) END AS band
FROM orders
"""


@query(
    f"""
SELECT o_orderkey,
       CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY priority DESC NULLS LAST) AS BIGINT) AS by_text,
       CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY priority DESC NULLS LAST) AS BIGINT) AS by_text_dense,
       CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY band NULLS FIRST) AS BIGINT) AS by_band,
       CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY band NULLS FIRST) AS BIGINT) AS by_band_dense
FROM ({_MIXED})
"""
)
def win_rank_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, nulls and few keys, on the way that large keys take."""
    orders = workspace(spark, sf_dir, "orders").query(_MIXED)
    for column, name, down in (("priority", "by_text", True), ("band", "by_band", False)):
        ranked = ordered.ranks(orders, ["o_orderstatus"], column, down, max_group_rows=100)
        orders = ranked.withColumnsRenamed({"rank": name, "dense_rank": f"{name}_dense"})
    names = ("by_text", "by_text_dense", "by_band", "by_band_dense")
    return orders.select("o_orderkey", *[F.col(c).cast("long").alias(c) for c in names])


@query(
    """
SELECT o_custkey, o_orderkey,
       lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_total
FROM orders
"""
)
def win_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"
    )
    return ordered.previous_value(
        orders,
        ["o_custkey"],
        ["o_orderdate", "o_orderkey"],
        "o_totalprice",
        "previous_total",
    ).select("o_custkey", "o_orderkey", "previous_total")


@query(
    """
SELECT o_orderpriority, o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) AS total,
       CAST(count(*) OVER w AS BIGINT) AS n
FROM orders
WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
"""
)
def win_moving_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and number of the last seven orders of a priority, of which a mean is made.
    A priority has a fifth of all orders, so its rows are cut into pieces."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderpriority", "o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("price")
    )
    measures = {"total": F.sum("price"), "n": F.count(F.lit(1))}
    found = ordered.moving(
        orders, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], measures, before=6, max_group_rows=1000
    )
    return found.select("o_orderpriority", "o_orderkey", F.col("total").cast("double").alias("total"), "n")


@query(
    """
SELECT o_orderpriority, o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) AS total,
       CAST(count(*) OVER w AS BIGINT) AS n
FROM (SELECT *, date_diff('day', TIMESTAMP '1970-01-01', o_orderdate) AS d FROM orders)
WINDOW w AS (PARTITION BY o_orderpriority ORDER BY d RANGE BETWEEN 6 PRECEDING AND 1 FOLLOWING)
"""
)
def win_moving_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the orders from six days before to one day after."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderpriority",
        "o_orderkey",
        F.unix_date(F.to_date("o_orderdate")).cast("long").alias("day"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
    )
    measures = {"total": F.sum("price"), "n": F.count(F.lit(1))}
    found = ordered.moving(
        orders, ["o_orderpriority"], ["day"], measures, before=6, after=1, by="range", max_group_rows=1000
    )
    return found.select("o_orderpriority", "o_orderkey", F.col("total").cast("double").alias("total"), "n")


@query(
    """
SELECT o_custkey, o_orderkey,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER
            (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_total
FROM orders
"""
)
def win_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderkey",
        "o_orderdate",
        F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
    )
    return ordered.running_sum(
        orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "total", "running"
    ).select(
        "o_custkey", "o_orderkey", F.col("running").cast("double").alias("running_total")
    )


@query(
    """
SELECT n, CAST(count(*) AS BIGINT) AS times FROM (
  SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier
  UNION ALL (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier))
GROUP BY n
"""
)
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir, "customer", "supplier").query(
        """
        WITH everyone AS (
          SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier
        ), once AS (
          SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier
        )
        SELECT n, count(*) AS times
        FROM (SELECT n FROM everyone UNION ALL SELECT n FROM once) GROUP BY n
        """
    )


_SETS = {
    "set_intersect": "SELECT {d} o_custkey AS person FROM orders INTERSECT SELECT {d} user_id FROM events",
    "set_except": "SELECT {d} o_custkey AS person FROM orders EXCEPT SELECT {d} user_id FROM events",
}


@query(_SETS["set_intersect"].format(d=""))
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side is reduced to distinct values before they meet."""
    return workspace(spark, sf_dir, "orders", "events").query(
        _SETS["set_intersect"].format(d="DISTINCT")
    )


@query(_SETS["set_except"].format(d=""))
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir, "orders", "events").query(
        _SETS["set_except"].format(d="DISTINCT")
    )


@query(
    """
WITH big AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders
             WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders))
SELECT o_orderkey, o_totalprice FROM big b
WHERE o_totalprice >= (SELECT max(o_totalprice) FROM orders x WHERE x.o_custkey = b.o_custkey)
"""
)
def subquery_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir, "orders").query(
        """
        WITH big AS (
          SELECT o_custkey, o_orderkey, o_totalprice FROM orders
          WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)
        )
        SELECT o_orderkey, o_totalprice FROM big b
        WHERE o_totalprice >=
              (SELECT max(o_totalprice) FROM orders x WHERE x.o_custkey = b.o_custkey)
        """
    )


@query(
    """
WITH placed AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS order_year, o_orderstatus FROM orders)
SELECT y.order_year, s.o_orderstatus AS status, CAST(count(p.order_year) AS BIGINT) AS orders
FROM (SELECT DISTINCT order_year FROM placed) y
CROSS JOIN (SELECT DISTINCT o_orderstatus FROM placed) s
LEFT JOIN placed p ON p.order_year = y.order_year AND p.o_orderstatus = s.o_orderstatus
GROUP BY ALL
"""
)
def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for every status that occurs, whichever these are; the columns
    are then turned into rows again, zeros included.

    Years and statuses are counted first; the pivot works on these counts.
    """
    orders = table(spark, sf_dir, "orders")
    counts = materialise(
        orders.groupBy(F.year("o_orderdate").cast("long").alias("order_year"), "o_orderstatus")
        .agg(F.count(F.lit(1)).alias("n")),
        "status-counts",
    )
    pivoted = counts.groupBy("order_year").pivot("o_orderstatus").sum("n")
    filled = pivoted.na.fill(0, [c for c in pivoted.columns if c != "order_year"])
    return filled.unpivot("order_year", None, "status", "orders")


@query(
    """
SELECT c_custkey, 'balance' AS measure, c_acctbal AS value FROM customer
UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE) FROM customer
"""
)
def unpivot_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir, "customer").query(
        """
        SELECT c_custkey, measure, value FROM (
          SELECT c_custkey, c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS nation
          FROM customer)
        UNPIVOT (value FOR measure IN (balance, nation))
        """
    )


@query(
    """
SELECT p_partkey, upper(p_name) AS upper_name, length(p_name) AS name_length,
       string_split(p_name, ' ')[2] AS second_word, regexp_extract(p_brand, '([0-9]+)', 1) AS brand_no,
       levenshtein(p_name, lower(p_type)) AS distance, replace(p_name, 'e', '_') AS replaced,
       lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, reverse(p_name) AS reversed,
       instr(p_name, 'r') AS r_at, substr(p_brand, 1, 5) AS prefix,
       concat_ws('|', p_brand, p_type) AS joined, translate(p_name, 'ab', 'xy') AS translated,
       starts_with(p_name, 'small') AS is_small
FROM part
"""
)
def scalar_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir, "part").query(
        """
        SELECT p_partkey, upper(p_name) AS upper_name, length(p_name) AS name_length,
               split(p_name, ' ')[1] AS second_word,
               regexp_extract(p_brand, '([0-9]+)', 1) AS brand_no,
               levenshtein(p_name, lower(p_type)) AS distance,
               replace(p_name, 'e', '_') AS replaced,
               lpad(CAST(p_size AS STRING), 4, '0') AS padded, reverse(p_name) AS reversed,
               instr(p_name, 'r') AS r_at, substr(p_brand, 1, 5) AS prefix,
               concat_ws('|', p_brand, p_type) AS joined,
               translate(p_name, 'ab', 'xy') AS translated,
               startswith(p_name, 'small') AS is_small
        FROM part
        """
    )


@query(
    """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day,
       strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start,
       CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days,
       CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q,
       CAST(dayofweek(o_orderdate) + 1 AS BIGINT) AS weekday,
       CAST(dayofyear(o_orderdate) AS BIGINT) AS day_of_year,
       strftime(last_day(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS month_end,
       strftime(o_orderdate + INTERVAL 45 DAY, '%Y-%m-%d') AS due
FROM orders
"""
)
def scalar_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates are stored as text in records, so they are cast first."""
    return workspace(spark, sf_dir, "orders").query(
        """
        WITH stored AS (
          SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS day FROM orders
        ), dated AS (SELECT *, to_date(day) AS d FROM stored)
        SELECT o_orderkey, day, date_format(trunc(d, 'MONTH'), 'yyyy-MM-dd') AS month_start,
               CAST(datediff(d, DATE '1995-01-01') AS BIGINT) AS days,
               CAST(year(d) AS BIGINT) AS y, CAST(quarter(d) AS BIGINT) AS q,
               CAST(dayofweek(d) AS BIGINT) AS weekday,
               CAST(dayofyear(d) AS BIGINT) AS day_of_year,
               date_format(last_day(d), 'yyyy-MM-dd') AS month_end,
               date_format(date_add(d, 45), 'yyyy-MM-dd') AS due
        FROM dated
        """
    )


@query(
    """
SELECT c_custkey, abs(c_acctbal) AS size, CAST(ceil(c_acctbal) AS BIGINT) AS up,
       CAST(floor(c_acctbal) AS BIGINT) AS down, sqrt(abs(c_acctbal)) AS root,
       round(ln(abs(c_acctbal) + 1), 6) AS log, CAST(sign(c_acctbal) AS DOUBLE) AS side,
       CASE WHEN c_nationkey = 0 THEN NULL ELSE c_acctbal / c_nationkey END AS share,
       coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment,
       greatest(c_acctbal, 0.0) AS credit, least(c_nationkey, 10) AS capped,
       CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS band
FROM customer
"""
)
def scalar_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir, "customer").query(
        """
        SELECT c_custkey, abs(c_acctbal) AS size, ceil(c_acctbal) AS up,
               floor(c_acctbal) AS down, sqrt(abs(c_acctbal)) AS root,
               round(ln(abs(c_acctbal) + 1), 6) AS log, sign(c_acctbal) AS side,
               try_divide(c_acctbal, c_nationkey) AS share,
               coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment,
               greatest(c_acctbal, 0.0D) AS credit, least(c_nationkey, 10) AS capped,
               CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low'
                    ELSE 'high' END AS band
        FROM customer
        """
    )


@query(
    """
SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum,
       CAST(count(DISTINCT json_extract_string(props, '$.k')) AS BIGINT) AS k_values,
       CAST(count(json_extract_string(props, '$.absent')) AS BIGINT) AS absent
FROM events GROUP BY event_type
"""
)
def json_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir, "events").query(
        """
        SELECT event_type, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k_sum,
               count(DISTINCT get_json_object(props, '$.k')) AS k_values,
               count(get_json_object(props, '$.absent')) AS absent
        FROM events GROUP BY event_type
        """
    )


@query(
    """
WITH amounts AS (
  SELECT l_returnflag, 'quantity' AS kind, l_quantity AS v FROM lineitem
  UNION ALL SELECT l_returnflag, 'price', l_extendedprice FROM lineitem
  UNION ALL SELECT l_returnflag, 'discount', l_discount FROM lineitem
  UNION ALL SELECT l_returnflag, 'tax', l_tax FROM lineitem
)
SELECT l_returnflag = 'R' AS returned, kind, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS total, max(v) AS highest
FROM amounts GROUP BY ALL
"""
)
def explode_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested amounts of JSON records, one row each, summed by kind."""
    records = render.line_json(spark, sf_dir)
    shape = "returned BOOLEAN, amounts ARRAY<STRUCT<kind STRING, value DOUBLE>>"
    parsed = compute_once(records, F.from_json("json", shape).alias("r"))
    return spark.sql(
        """
        WITH items AS (SELECT r.returned, inline(r.amounts) AS (kind, value) FROM {line_record})
        SELECT returned, kind, count(*) AS n,
               CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
               max(value) AS highest
        FROM items GROUP BY returned, kind
        """,
        line_record=parsed,
    )
