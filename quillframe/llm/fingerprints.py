"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

In DataFrame expressions only. A text is cut into sentences (a longer run
without an end mark every ``SENTENCE`` code points), whose concatenation is the
text. A sentence that has a line break ends its paragraph; one that has a blank
line, or whose hash falls on ``SECTION``, ends its section too, so boundaries
follow from the content and an edit moves none but its own. Each sentence is
hashed; a paragraph's hash is that of its sentences' hashes, a section's that of
its paragraphs', the root that of the sections'. Equal texts have equal roots
and others have not.

The fingerprint is the root, a colon and the tree: for each sentence eight
hexadecimal digits and its length, ended by ``,`` inside a paragraph, ``;`` at
the end of one and ``|`` at the end of a section. Likeness of two fingerprints is
1 for equal ones, else the Dice coefficient of their distinct sentences, weighted
by length. ``edit_span`` descends from the root into the differing branches only
and says where two texts differ.

Cases: a null text is empty; an empty text's tree has no sentence, and its
likeness to any other is 0. Texts of any length are read whole, in linear time.
``with_next`` takes the documents in descending order of id, then of a hash of
the text; rows equal in both are one document there, so each of them gets the
same next one. A null id comes after all others. A single document is its own
next one. An empty table gives an empty result. Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.text import let
from quillframe.llm.common import private, query, table
from quillframe.operators.ordered import with_ordinals

#: Code points of a run without an end mark that make up one sentence.
SENTENCE = 64
#: Pieces that put together are the text; plain character classes, so that Java
#: needs no stack for them.
PIECE = rf"[^\n.!?;]{{0,{SENTENCE}}}[\n.!?;]+ *|[^\n.!?;]{{1,{SENTENCE}}}"
#: First digits of a sentence hash that end a section: one paragraph in eight.
SECTION = "[01]"
#: Hexadecimal digits of a sentence hash that the fingerprint keeps.
DIGITS = 8
HASH = 64


def pieces_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))


def tree_of(text: Column) -> Column:
    """All sentences as one string: hash, length and end sign of each."""

    def leaf(piece: Column) -> Column:
        def ended(code: Column) -> Column:
            section = piece.contains("\n\n") | code.rlike(f"^{SECTION}")
            sign = F.when(~piece.contains("\n"), ",").when(section, "|").otherwise(";")
            return F.concat(code, F.length(piece).cast("string"), sign)

        return let(F.sha2(piece, 256), ended)

    return F.array_join(F.transform(pieces_of(text), leaf), "")


def sections_of(tree: Column) -> Column:
    return F.array_remove(F.split(tree, r"(?<=\|)"), "")


def section_hash(section: Column) -> Column:
    paragraphs = F.array_remove(F.split(section, r"(?<=;)"), "")
    return F.sha2(F.array_join(F.transform(paragraphs, lambda p: F.sha2(p, 256)), ""), 256)


def root_of(tree: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sections_of(tree), section_hash), ""), 256)


def print_of(tree: Column) -> Column:
    """The root and the shortened tree."""
    short = F.regexp_replace(tree, rf"([0-9a-f]{{{DIGITS}}})[0-9a-f]{{{HASH - DIGITS}}}", "$1")
    return F.concat(root_of(tree), F.lit(":"), short)


def fingerprint(text: Column) -> Column:
    return let(tree_of(text), print_of)


def sentences(print_: Column) -> Column:
    """The distinct sentences of a fingerprint, each with its length."""
    tree = print_.substr(F.lit(HASH + 2), F.length(print_))
    return F.array_distinct(F.array_remove(F.split(tree, "[,;|]"), ""))


def weight(parts: Column) -> Column:
    return F.aggregate(
        parts,
        F.lit(0).cast("long"),
        lambda total, p: total + p.substr(F.lit(DIGITS + 1), F.length(p)).cast("long"),
    )


def likeness(one: Column, other: Column) -> Column:
    """0 to 1: how much of two fingerprints' sentences is common."""

    def dice(a: Column, b: Column) -> Column:
        both = weight(F.array_intersect(a, b))
        return F.lit(2.0) * both / (weight(a) + weight(b))

    unequal = let(sentences(one), lambda a: let(sentences(other), lambda b: dice(a, b)))
    return F.when(one == other, F.lit(1.0)).otherwise(unequal)


def first_difference(one: Column, other: Column) -> Column:
    """How many leading elements two arrays have in common."""
    unlike = F.zip_with(one, other, lambda a, b: ~a.eqNullSafe(b))
    place = F.array_position(unlike, True)
    return F.when(place > 0, place - 1).otherwise(F.size(one)).cast("int")


def edit_span(one: Column, other: Column) -> Column:
    """Where a text differs from another: ``start, end`` in code points, by the
    trees of both; null if they are equal.

    Equal sections at both ends are passed over by their hashes; sentences are
    compared in the sections between them only.
    """

    def leaves(sections: Column, head: Column, tail: Column) -> Column:
        inner = F.slice(sections, head + 1, F.greatest(F.size(sections) - head - tail, F.lit(0)))
        return F.array_remove(F.split(F.array_join(inner, ""), r"(?<=[,;|])"), "")

    def chars(parts: Column) -> Column:
        return F.aggregate(
            parts,
            F.lit(0).cast("long"),
            lambda n, p: n + F.regexp_extract(p, rf"^.{{{HASH}}}([0-9]+)", 1).cast("long"),
        )

    def all_chars(sections: Column) -> Column:
        return chars(F.array_remove(F.split(F.array_join(sections, ""), r"(?<=[,;|])"), ""))

    def ends(a: Column, b: Column, tail_of: Column) -> Column:
        """Common elements at the end that the common start does not take."""
        back = first_difference(F.reverse(a), F.reverse(b))
        return F.least(back, F.size(a) - tail_of, F.size(b) - tail_of)

    def between(a: Column, b: Column, head: Column, tail: Column) -> Column:
        def span(x: Column, y: Column) -> Column:
            return let(
                first_difference(x, y),
                lambda h: let(
                    ends(x, y, h),
                    lambda t: let(
                        all_chars(F.slice(a, F.lit(1), head)),
                        lambda base: F.struct(
                            (base + chars(F.slice(x, F.lit(1), h))).alias("start"),
                            (base + chars(F.slice(x, F.lit(1), F.size(x) - t))).alias("end"),
                        ),
                    ),
                ),
            )

        return let(leaves(a, head, tail), lambda x: let(leaves(b, head, tail), lambda y: span(x, y)))

    def descend(a: Column, b: Column, ha: Column, hb: Column) -> Column:
        return let(
            first_difference(ha, hb),
            lambda head: let(ends(ha, hb, head), lambda tail: between(a, b, head, tail)),
        )

    found = let(
        sections_of(one),
        lambda a: let(
            sections_of(other),
            lambda b: let(
                F.transform(a, section_hash),
                lambda ha: let(F.transform(b, section_hash), lambda hb: descend(a, b, ha, hb)),
            ),
        ),
    )
    return F.when(one != other, found)


def with_next(
    docs: DataFrame, made: dict[str, Column], half: Column, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with the columns ``made`` of each document's next one, and
    ``next_text``, its first ``half`` code points (``half`` is of this document).

    Only ids and hashes are ordered. A document's columns then move once to the
    document before it, and every table is dealt out by the same 128-bit hash of
    id and text, so no row moves twice.
    """
    name = {n: private(n) for n in ("one", "two", "at", "want", "own_one", "own_two")}
    one, two, at, want, own_one, own_two = name.values()
    seen = [F.col(key).isNull(), F.col(key), F.coalesce(text, F.lit(""))]
    rows = docs.withColumns({one: F.xxhash64(*seen), two: F.xxhash64(F.lit("two"), *seen)})
    places = with_ordinals(
        rows.groupBy(one, two).agg(F.first(key).alias(key), F.first(half).alias(want)),
        [key, one, two],
        at,
    )
    last = places.agg(F.max(at)).first()[0] or 0
    # ascending, so the next document in descending order is one place lower
    before = places.select(
        F.col(one).alias(own_one),
        F.col(two).alias(own_two),
        F.when(F.col(at) == 1, F.lit(last)).otherwise(F.col(at) - 1).alias(at),
        want,
    )
    seen_at = places.select(F.col(one).alias(f"{at}_1"), F.col(two).alias(f"{at}_2"), F.col(key).alias(f"{at}_k"), at)
    pairs = seen_at.join(before, at).drop(at)
    # the id is compared as well; both joins thus need the same columns of the same rows,
    # which are dealt out once and read twice
    same = F.coalesce(rows[key] == F.col(f"{at}_k"), rows[key].isNull() & F.col(f"{at}_k").isNull())
    on = (rows[one] == F.col(f"{at}_1")) & (rows[two] == F.col(f"{at}_2")) & same
    sent = (
        rows.join(pairs, on)
        .select(
            F.col(own_one).alias(one),
            F.col(own_two).alias(two),
            F.coalesce(text, F.lit("")).substr(F.lit(1), F.col(want)).alias("next_text"),
            *(c.alias(n) for n, c in made.items()),
        )
        .dropDuplicates([one, two])
    )
    return rows.join(sent, [one, two]).drop(one, two)


def half_of(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 2).cast("int")


def edited(text: Column, next_text: Column) -> Column:
    """The text with its second half replaced by the start of the next one."""
    whole = F.coalesce(text, F.lit(""))
    return F.concat(whole.substr(F.lit(1), F.length(whole) - half_of(text)), next_text)


def _sql_tree(name: str, text: str) -> str:
    """SQL for (doc_id, fingerprint, pieces) of a text column ``t``."""
    leaf = "substr(sha256(p), 1, {n}) || length(p) || CASE WHEN NOT contains(p, chr(10)) THEN ',' WHEN contains(p, chr(10) || chr(10)) OR regexp_matches(sha256(p), '^{s}') THEN '|' ELSE ';' END"
    full, short = (leaf.format(n=n, s=SECTION) for n in (HASH, DIGITS))
    join = "coalesce(array_to_string(list_transform(pieces, lambda p: {leaf}), ''), '')"
    parts = "list_filter(string_split(regexp_replace({x}, '\\{sign}', '{sign}~', 'g'), '~'), lambda x: x <> '')"
    section = f"sha256(array_to_string(list_transform({parts.format(x='s', sign=';')}, lambda p: sha256(p)), ''))"
    return f"""{name}_pieces AS (
  SELECT doc_id, t, regexp_extract_all(t, '{PIECE}') AS pieces FROM (SELECT doc_id, {text} AS t FROM whole)
), {name}_trees AS (
  SELECT doc_id, t, pieces, {join.format(leaf=full)} AS tree, {join.format(leaf=short)} AS short FROM {name}_pieces
), {name} AS (
  SELECT doc_id, t, pieces, sha256(coalesce(array_to_string(list_transform(
      {parts.format(x="tree", sign="|")}, lambda s: {section}), ''), '')) || ':' || short AS fp,
    list_distinct(list_filter(regexp_split_to_array(short, '[,;|]'), lambda x: x <> '')) AS parts
  FROM {name}_trees
)"""


def _sql_like(one: str, other: str) -> str:
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda p: CAST(substr(p, {DIGITS + 1}) AS BIGINT))), 0)"
    common = size(f"list_intersect({one}.parts, {other}.parts)")
    total = f"({size(f'{one}.parts')} + {size(f'{other}.parts')})"
    return f"CASE WHEN {one}.fp = {other}.fp THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * {common} / {total} END"


ORACLE = f"""
WITH whole AS (
  SELECT doc_id, t, length(t) // 2 AS half,
    coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
    coalesce(lead(t) OVER w, first_value(t) OVER w) AS next_t
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
  WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), {_sql_tree("own", "t")}, {_sql_tree("changed", "left(t, length(t) - half) || left(next_t, half)")}
SELECT w.doc_id, length(w.t) AS n_chars, sha256(changed.t) AS edited_sha256, own.fp AS fingerprint,
  changed.fp AS edited_fingerprint, {_sql_like("own", "changed")} AS near_edited,
  {_sql_like("own", "other")} AS near_next,
  CASE WHEN own.fp <> changed.fp THEN CAST(coalesce(list_sum(list_transform(
    own.pieces[1:coalesce(list_position(list_transform(range(1, greatest(len(own.pieces), len(changed.pieces)) + 1),
      lambda i: own.pieces[i] IS DISTINCT FROM changed.pieces[i]), true), 0) - 1], lambda p: length(p))), 0) AS BIGINT) END AS edit_start
FROM whole w JOIN own USING (doc_id) JOIN changed USING (doc_id) JOIN own other ON other.doc_id = w.next_id
"""


@query(ORACLE)
def op11_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, that of an edited version, and likenesses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.col("text")
    pairs = with_next(docs, {"next_fingerprint": fingerprint(text)}, half_of(text))
    whole = F.coalesce(text, F.lit(""))
    changed = pairs.select("doc_id", whole.alias("text"), edited(text, F.col("next_text")).alias("edited"), "next_fingerprint")
    trees = changed.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        tree_of(text).alias("tree"),
        tree_of(F.col("edited")).alias("edited_tree"),
        "next_fingerprint",
    )
    prints = trees.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        print_of(F.col("tree")).alias("fingerprint"),
        print_of(F.col("edited_tree")).alias("edited_fingerprint"),
        "next_fingerprint",
        edit_span(F.col("tree"), F.col("edited_tree"))["start"].alias("edit_start"),
    )
    return prints.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        "edit_start",
    )
