"""Secret scans with corpus-wide ownership, in DataFrame expressions only.

Base kinds, each leftmost and without overlaps: ``assign`` (a password-like name
given a value of six characters or more), ``access`` (AKIA and 16 more) and
``hex`` (24 or more hexadecimal digits). The scan adds ``key`` (values with a
provider's prefix), ``jwt``, ``pem`` (a private key's header line) and ``block``
(a private key as a whole, which is hashed by its body alone).

Every found value is hashed, and over the whole corpus the distinct owners and
repositories (of an owner) of each hash are counted. A value that
``COMMON_OWNERS`` owners or ``COMMON_REPOSITORIES`` repositories have is a widely
copied example (``copied``). One that fewer have is live-looking (``live``) if it
is a whole key, if something is assigned to a secret's name that is neither a
plain word nor a placeholder, or if its characters look random; the rest is
``other``.

Positions come from the expressions themselves: the pieces between matches and
the matches, by the same pattern, sum up to code points.

Cases: a null or empty text has no spans. A null owner or repository counts as
one of its own. Repeated rows add nothing to the counts of owners. An empty
table gives an empty result. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.text import let
from quillframe.llm.common import by_shuffle, private, query, table
from quillframe.session import materialise

#: Fixed patterns, in the order of the kinds. ``(?i)`` stands for ASCII letters.
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 6
#: A whole private key. Possessive, so that a header without an end is read once;
#: line breaks may be escaped ones, as in JSON and source code.
BLOCK = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:[^-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:(?:\s|\\[nr]|[\"',])*+[A-Za-z0-9+/]{40,}+={0,2})++)"
)
KINDS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "key": r"(?:gh[pousr]_|sk_(?:live|test)_|xox[abpr]-|glpat-)[A-Za-z0-9_-]{16,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "block": BLOCK,
}
BASE = ("assign", "access", "hex")
#: What of a key is no part of its body: the lines around it, headers, line breaks.
NO_BODY = r"-----[A-Z ]+-----|[A-Za-z-]+: [^\n\\]*|\\[nrt]|[^A-Za-z0-9+/]"
#: Owners from which on a value counts as widely copied.
COMMON_OWNERS = 3
#: The same for distinct pairs of owner and repository.
COMMON_REPOSITORIES = 3
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your|test|x{4,}|0{6,}|1234567"
#: A digit, or a change of case inside a word: no plain words of running text.
NOT_PLAIN = r"[0-9]|[a-z][A-Z]"
#: Different characters that a live-looking value has at least.
LIVE_CHARACTERS = 8
#: Numbers that are summed one by one; see running_sum.
RUN = 128
REDACTED = "[SECRET]"


def running_sum(numbers: Column) -> Column:
    """Sums of the first 0, 1, 2, ... numbers. In runs: growing an array by one
    element copies it, so this is done once for RUN numbers.

    What a lambda mentions is computed at every call, so the numbers and the
    sums of runs are bound first."""

    def sums(values: Column) -> Column:
        def part(start: Column, n: Column) -> Column:
            return F.aggregate(F.slice(values, start, n), F.lit(0), lambda a, x: a + x)

        size = F.size(values)
        bases = F.aggregate(
            F.sequence(F.lit(0), F.floor(size / RUN).cast("int")),
            F.array(F.lit(0)),
            lambda a, r: F.concat(a, F.array(F.element_at(a, -1) + part(r * RUN + 1, F.lit(RUN)))),
        )

        def at(bound: Column, i: Column) -> Column:
            run = F.floor(i / RUN).cast("int")
            return F.get(bound, run) + part(run * RUN + 1, i % RUN)

        return let(bases, lambda b: F.transform(F.sequence(F.lit(0), size), lambda i: at(b, i)))

    return let(numbers, sums)


def spans_of(text: Column, kind: str) -> Column:
    """``array<struct<start, rank, end, kind, value>>`` of one kind in a text."""
    pattern, rank = KINDS[kind], list(KINDS).index(kind)
    row = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(found: Column) -> Column:
        # piece 0, match 0, piece 1, ...: starts lie behind pieces, ends behind matches
        lengths = F.flatten(
            F.zip_with(
                F.split(text, pattern, -1),
                found,
                lambda p, m: F.array(F.length(p), F.coalesce(F.length(m), F.lit(0))),
            )
        )
        value = lambda m: F.regexp_extract(m, pattern, 2) if kind == "assign" else m

        def span(sums: Column, m: Column, i: Column) -> Column:
            return F.struct(
                F.get(sums, 2 * i + 1).alias("start"),
                F.lit(rank).alias("rank"),
                F.get(sums, 2 * i + 2).alias("end"),
                F.lit(kind).alias("kind"),
                value(m).alias("value"),
            )

        return let(
            running_sum(lengths),
            lambda sums: F.transform(found, lambda m, i: span(sums, m, i)).cast(row),
        )

    def kept(spans: Column) -> Column:
        if kind != "assign":
            return spans
        return F.filter(spans, lambda s: F.length(s["value"]) >= ASSIGN_LEAST)

    spans = let(matches, lambda found: F.when(F.size(found) > 0, kept(placed(found))))
    return F.coalesce(spans, F.array().cast(row))


def find_secrets(text: Column, kinds: Iterable[str] = KINDS) -> Column:
    """All spans of a text, by start, then kind as listed, then end."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*(spans_of(text, kind) for kind in kinds)))


def hash_of(span: Column) -> Column:
    """The hash that stands for a span's value; for a whole key, for its body."""
    body = F.regexp_replace(span["value"], NO_BODY, "")
    return F.sha2(F.when(span["kind"] == "block", body).otherwise(span["value"]), 256)


def looks_live(value: Column, kind: Column) -> Column:
    """Whole keys; assigned values that are neither plain words nor placeholders
    (what follows a name like ``secret:`` in running text is mostly a plain word);
    of other kinds, letters and digits with many different characters."""
    characters = F.array_remove(F.split(value, ""), "")
    random = (
        (F.size(F.array_distinct(characters)) >= LIVE_CHARACTERS)
        & value.rlike("[0-9]")
        & value.rlike("[A-Za-z]")
    )
    assigned = value.rlike(NOT_PLAIN)
    return (kind == "block") | (F.when(kind == "assign", assigned).otherwise(random) & ~value.rlike(PLACEHOLDER))


def ownership(values: DataFrame) -> DataFrame:
    """``value_hash, owners, repositories`` of ``value_hash, owner, repository``.

    Owners and repositories become distinct per hash before they are counted,
    and both steps add up within tasks first, so a value that is everywhere is
    a row per task.
    """
    owned = values.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = owned.groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value_hash").agg(
        F.count("*").alias("owners"), F.sum("n").alias("repositories")
    )


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    repository: str = "lang",
    kinds: Iterable[str] = KINDS,
) -> DataFrame:
    """``doc_id, text_key, spans, classes`` for every document.

    ``classes`` maps the hash of each value in the document to ``live``,
    ``copied`` or ``other``. An owner's repositories are told apart by the
    column ``repository``. Texts are read once; equal texts share a key, by
    which the classes come back, so ids need not be unique.
    """
    found = materialise(
        docs.select(
            F.col(key).alias("doc_id"),
            F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_key"),
            F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
            F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
            find_secrets(F.col(text), kinds).alias("spans"),
        ),
        "secrets",
    )
    values = (
        found.where(F.size("spans") > 0)
        .select(
            "text_key",
            "owner",
            "repository",
            F.explode(
                F.array_distinct(
                    F.transform(
                        "spans", lambda s: F.struct(s["kind"], s["value"], hash_of(s))
                    )
                ).cast("array<struct<kind:string,value:string,value_hash:string>>")
            ).alias("found"),
        )
        .select(
            "text_key",
            "owner",
            "repository",
            "found.value_hash",
            looks_live(F.col("found.value"), F.col("found.kind")).alias("random"),
        )
    )
    common = (F.col("owners") >= COMMON_OWNERS) | (F.col("repositories") >= COMMON_REPOSITORIES)
    kind = F.when(common, "copied").when(F.col("random"), "live").otherwise("other")
    classes = (
        values.groupBy("text_key", "value_hash")
        .agg(F.max("random").alias("random"))
        .join(by_shuffle(ownership(values)), "value_hash")
        .groupBy("text_key")
        .agg(F.map_from_entries(F.collect_list(F.struct("value_hash", kind))).alias("classes"))
    )
    return found.join(by_shuffle(classes), "text_key", "left").drop("owner", "repository")


def of_class(name: str) -> Column:
    """The spans of ``scan`` whose value has a class."""
    return F.filter(F.col("spans"), lambda s: F.col("classes")[hash_of(s)] == name)


def redact(text: Column, spans: Column) -> Column:
    """The text with the values of the spans replaced by REDACTED.

    A value is the last part of its span. Overlapping ones are replaced once.
    """
    places = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                (s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end")
            ),
        )
    )

    def step(done: Column, place: Column) -> Column:
        before = text.substr(done["at"] + 1, place["start"] - done["at"])
        return F.struct(
            F.greatest(done["at"], place["end"]).alias("at"),
            F.when(place["start"] >= done["at"], F.concat(done["out"], before, F.lit(REDACTED)))
            .otherwise(done["out"])
            .alias("out"),
        )

    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda done: F.concat(done["out"], text.substr(done["at"] + 1, F.length(text))),
    )


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["rank"] < len(BASE))


def listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


#: The same key pattern without lookahead and possessive repeats, which RE2 lacks.
_SQL_KINDS = KINDS | {
    "block": r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:[^-]|-{1,4}[^-])*-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:(?:[\s\x0B]|\\[nr]|[\"',])*[A-Za-z0-9+/]{40,}={0,2})+)"
}


def _sql_spans(kind: str) -> str:
    pattern, rank = _SQL_KINDS[kind].replace("'", "''"), list(KINDS).index(kind)
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, m AS match,
         CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)
              + coalesce(list_sum(list_transform(all_m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, p, all_m, unnest(all_m) AS m, unnest(range(1, len(all_m) + 1)) AS i
        FROM (SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS p,
                     regexp_extract_all(t, '{pattern}') AS all_m FROM d))"""


_PLACEHOLDER = PLACEHOLDER.replace("'", "''")
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents
), found AS ({" UNION ALL ".join(_sql_spans(k) for k in KINDS)}
), spans AS (
  SELECT doc_id, rank, kind, s, s + length(match) AS e, value FROM (
    SELECT *, CASE WHEN kind = 'assign'
      THEN regexp_extract(match, '{ASSIGN.replace("'", "''")}', 2)
      WHEN kind = 'block' THEN regexp_replace(match, '{NO_BODY}', '', 'g') ELSE match END AS value FROM found)
  WHERE kind <> 'assign' OR length(value) >= {ASSIGN_LEAST}
), owners AS (
  SELECT value, count(DISTINCT coalesce(source, '')) AS owners,
         count(DISTINCT {{'owner': coalesce(source, ''), 'repository': coalesce(lang, '')}}) AS repositories
  FROM spans JOIN d USING (doc_id) GROUP BY value
), judged AS (
  SELECT *, bool_or(kind = 'block' OR (NOT regexp_matches(value, '{_PLACEHOLDER}') AND CASE
    WHEN kind = 'assign' THEN regexp_matches(value, '{NOT_PLAIN}')
    ELSE len(list_distinct(string_split(value, ''))) >= {LIVE_CHARACTERS}
      AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') END))
    OVER (PARTITION BY doc_id, value) AS live
  FROM spans
), classed AS (
  SELECT judged.*, CASE WHEN owners >= {COMMON_OWNERS} OR repositories >= {COMMON_REPOSITORIES} THEN 'copied'
    WHEN live THEN 'live' ELSE 'other' END AS class
  FROM judged JOIN owners USING (value)
), listed AS (
  SELECT doc_id,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (class = 'live') AS n_live,
    count(*) FILTER (class = 'copied') AS n_copied,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < {len(BASE)}) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans
  FROM classed GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN listed USING (doc_id)
"""


@query(ORACLE)
def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, and how many are live-looking or copied."""
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter(F.col("spans"), lambda s: s["kind"] == kind))
    return found.select(
        "doc_id",
        *(count(kind).cast("long").alias(f"n_{kind}") for kind in BASE),
        F.sha2(listed(base_of(F.col("spans"))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.coalesce(F.size(of_class("live")), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce(F.size(of_class("copied")), F.lit(0)).cast("long").alias("n_copied"),
    )


def redact_live(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: values of live-looking secrets, private keys as a whole, are
    replaced in the texts, ``n_chars``, if there is one, follows; every document stays."""
    name, live = private("text"), private("live")
    marked = (
        scan(docs)
        .select(F.col("text_key").alias(name), of_class("live").alias(live))
        .where(F.size(live) > 0)
        .dropDuplicates([name])
    )
    joined = docs.join(marked, F.sha2(F.coalesce("text", F.lit("")), 256) == F.col(name), "left")
    text = F.when(F.col(live).isNotNull(), redact(F.col("text"), F.col(live))).otherwise(F.col("text"))
    done = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        size = F.when(F.col(live).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
        done = done.withColumn("n_chars", size)
    return done.drop(name, live)
