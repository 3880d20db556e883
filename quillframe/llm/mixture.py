"""Mixing sources to target weights by Poisson replication.

A source's weight is its share of the output's text. Its mean repetition rate is
the text it should have divided by the text it has, and every document appears
as often as a Poisson number with that mean says. The number comes from
inverting the distribution at uniform numbers hashed from seed and document
key, so it is the same in every run, on every executor and for every order of
rows. Copies are then dealt over all partitions, and ordered within them, by a
hash of seed, key and copy.

A rate above ``PART`` is split into equal parts, each inverted on its own: their
sum is again a Poisson number with the whole mean, and no probability is too
small for a double.

Cases: a null source is a source of its own; a null or empty text counts as no
text; a source without any text keeps rate 1. Rows with the same key (repeated
or null) get the same number of copies. Empty tables give an empty result.
Columns of the documents stay; ``copy`` (named by the caller) is added, in place
of a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import private, query, table
from quillframe.session import materialise

SEED = 17
#: Weight of a source: its text to this power (1 keeps the shares, 0 evens them).
EVENNESS = 0.5
PART = 32.0
#: Terms of the distribution kept; beyond them lies less than 1e-20 at mean PART.
TERMS = 120
#: Sources that are joined by broadcast at most; more are joined by shuffling.
BROADCAST_SOURCES = 10_000
#: The hash gives 13 hexadecimal digits, as many as a double holds exactly.
DIGITS = 13


def source_rates(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    weights: dict[str, float] | None = None,
    total_bytes: float | None = None,
) -> DataFrame:
    """``source, rate`` for every source of ``docs``.

    ``weights`` are the target shares by source name (a source that is not
    named gets 0); None takes each source's text to the power ``EVENNESS``.
    ``total_bytes`` is the text wanted in all, by default as much as there is.
    """
    # stored: totals, rates and their number come from one reading of the texts
    sizes = materialise(
        docs.groupBy(F.col(source).alias("source")).agg(
            F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).alias("bytes")
        ),
        "source-sizes",
    )
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(EVENNESS)))
    else:
        named = docs.sparkSession.createDataFrame(list(weights.items()), "name string, weight double")
        weighted = sizes.join(named, F.col("source").eqNullSafe(F.col("name")), "left").withColumn(
            "weight", F.coalesce("weight", F.lit(0.0))
        )
    totals = weighted.agg(F.sum("bytes").alias("b"), F.sum("weight").alias("w")).first()
    have, share = float(totals.b or 0), float(totals.w or 0)
    if weights is not None and have and not share:
        raise ValueError("no source of the documents has a weight")
    goal = (have if total_bytes is None else float(total_bytes)) / (share or 1.0)
    rate = F.when(F.col("bytes") == 0, F.lit(1.0)).otherwise(
        F.col("weight") * F.lit(goal) / F.col("bytes")
    )
    return weighted.select("source", rate.alias("rate"))


def cumulative(mean: Column) -> Column:
    """The distribution function of a Poisson number at 0, 1, 2, ..."""
    terms = F.transform(
        F.sequence(F.lit(0), F.lit(TERMS)),
        lambda k: F.when(mean == 0, F.when(k == 0, 1.0).otherwise(0.0)).otherwise(
            F.exp(k * F.log(mean) - mean - F.aggregate(
                F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i)
            ))
        ),
    )
    return F.transform(
        F.sequence(F.lit(1), F.lit(TERMS + 1)),
        lambda n: F.aggregate(F.slice(terms, F.lit(1), n), F.lit(0.0), lambda a, x: a + x),
    )


def uniform(seed: int, key: Column, part: Column) -> Column:
    """A number in [0, 1) from a hash of seed, key and part."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), part.cast("string")))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(16.0**DIGITS)


def replicate(
    docs: DataFrame,
    rates: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    copy: str = "copy",
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with every row as often as its Poisson number says, numbered by
    ``copy`` from 1, in an order that a hash decides."""
    name, parts, steps, order, n = (private(x) for x in ("source", "parts", "cdf", "order", "n"))
    m = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    ladder = rates.select(
        F.col("source").alias(name),
        m.alias(parts),
        cumulative(F.col("rate") / m).alias(steps),
    )
    if rates.count() <= BROADCAST_SOURCES:
        ladder = F.broadcast(ladder)  # TERMS numbers for each source
    numbers = F.transform(
        F.sequence(F.lit(0), F.col(parts) - 1), lambda j: uniform(seed, F.col(key), j)
    )
    count = F.aggregate(
        numbers,
        F.lit(0),
        lambda total, u: total + F.size(F.filter(F.col(steps), lambda c: c <= u)),
    )
    drawn = docs.join(ladder, F.col(source).eqNullSafe(F.col(name)))
    numbered = drawn.withColumn(n, count).where(F.col(n) > 0).withColumn(
        copy, F.explode(F.sequence(F.lit(1), F.col(n)))
    )
    dealt = F.xxhash64(F.lit(seed), F.col(key), F.col(copy))
    return (
        numbered.drop(name, parts, steps, n)
        .withColumn(order, dealt)
        .repartition(F.col(order))
        .sortWithinPartitions(order)
        .drop(order)
    )


ORACLE = f"""
WITH sizes AS (
  SELECT source, sum(strlen(coalesce(text, ''))) AS bytes FROM documents GROUP BY source
), rates AS (
  SELECT source, CASE WHEN bytes = 0 THEN 1.0 ELSE pow(CAST(bytes AS DOUBLE), {EVENNESS})
    * ((SELECT CAST(sum(bytes) AS DOUBLE) FROM sizes)
       / (SELECT sum(pow(CAST(bytes AS DOUBLE), {EVENNESS})) FROM sizes)) / bytes END AS rate
  FROM sizes
), parted AS (
  SELECT source, rate, greatest(CAST(ceil(rate / {PART}) AS INTEGER), 1) AS parts FROM rates
), terms AS (
  SELECT source, parts, k, CASE WHEN rate = 0 THEN CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END
    ELSE exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1)) END AS p
  FROM parted, (SELECT unnest(range(0, {TERMS + 1})) AS k)
), ladder AS (
  SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms
), drawn AS (
  SELECT doc_id, source, j, CAST('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR) || ':'
    || CAST(j AS VARCHAR)), 1, {DIGITS}) AS BIGINT) / pow(16.0, {DIGITS}) AS u
  FROM (SELECT d.doc_id, d.source, unnest(range(0, parts)) AS j
        FROM documents d JOIN parted p ON d.source IS NOT DISTINCT FROM p.source)
), counts AS (
  SELECT d.doc_id, sum(CASE WHEN l.c <= d.u THEN 1 ELSE 0 END) AS n
  FROM drawn d JOIN ladder l ON d.source IS NOT DISTINCT FROM l.source GROUP BY d.doc_id
)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, CAST(n AS BIGINT) + 1)) AS INTEGER) AS copy
FROM documents JOIN counts USING (doc_id) WHERE n > 0
"""


@query(ORACLE)
def op9_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, replicated so that sources have evened shares of the text."""
    docs = table(spark, sf_dir, "documents")
    return replicate(docs, source_rates(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the kept documents as a mixture of their sources."""
    return replicate(docs, source_rates(docs))
