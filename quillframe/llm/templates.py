"""Main text of web pages by deducing each host's template.

A page is read as a sequence of tokens: tags, each with the path of elements it
stands in, the words outside the element that holds the main text, and inside it
whole blocks of text. Over all pages of a host every token has an occurrence
vector, the number of times it occurs on each page. Tokens with equal vectors
form an equivalence class. A class is valid if it is large and has support and its
tokens occur once per page. The class of largest support comes first; another
is nested if all its tokens lie, by their mean places, in one gap of those taken
before, and is left out otherwise. The nested classes in order are the host's
template. On a page a token counts as template only where it continues that order.
What lies between template tokens are slots.

On pages whose main element (found by element and class names) has text, the
main text is the data of the slots inside that element: blocks that the template
has there (a call to subscribe below every article) go, by their text and without
regard to names. If they were more than half of the element's text, the page is a copy
rather than framed by them, and keeps all of it. On pages without a main element it is
the data of the slots that hold running text.

Vectors are never gathered: an exclusive or of hashes of (page, count) stands
for a vector, so that a host of any size is a row per token and task.

Cases: a null or empty page, or one without text, gives an empty text; broken
markup is read to its end (an unclosed comment or script swallows the rest, as
in browsers); pages without a url share one host. Repeated pages are extracted
alike, and count once towards their host's template. An empty table gives an empty result. Other columns stay out of the way.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import private, query, raw_texts, table
from quillframe.session import materialise

#: A host's class needs this many tokens and pages, and this share of its pages.
MIN_TOKENS = 3
MIN_PAGES = 4
MIN_SHARE = 0.5

#: Elements whose content is no markup, up to their end tag.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes")
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?)(?:</(?P=raw)[^>]*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-z][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that stand inside a line of text; all others end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that are never main text.
OUTSIDE = frozenset(
    "nav header footer aside form button select option dialog menu object svg canvas map head audio video".split()
)
#: Words in class, id or role that say the same of an element.
OUTSIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumbs?|comments?|contentinfo|"
    r"complementary|consent|cookies?|disqus|dialog|footer|header|masthead|menu|modal|nav|navbar|navigation|"
    r"newsletter|notices?|pagination|popup|promo|promoted|related|replies|respond|search|share|sharing|sidebar|"
    r"social|sponsored|sponsor|subscribe|toolbar|widget)(?=$|[\s_-]|\d)",
    re.I,
)
MAIN = frozenset(("article", "main"))
MAIN_WORDS = re.compile(
    r"(?:^|[\s_-])(?:main|article|content|post|entry|story|body)(?:[\s_-](?:content|body|text|main))?$", re.I
)
#: End tags that these start tags imply.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
          "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
BARRIER = frozenset("body article main section div ul ol dl table nav aside header footer form blockquote td th".split())


@dataclass
class Block:
    """A run of text between block tags."""

    parts: list[str] = field(default_factory=list)
    outside: bool = False
    main: int = 0
    path: str = ""

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def attributes(rest: str) -> tuple[str, bool]:
    """The words of class, id and role, and whether the element is hidden."""
    names, hidden = [], False
    for match in ATTRIBUTE.finditer(rest):
        name, value = match[1].lower(), (match[2] or "").strip("\"'")
        if name in ("class", "id", "role"):
            names.append(value)
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        else:
            hidden |= name == "hidden" or value.lower() == "true"
    return " ".join(names), hidden


def parse(page: str) -> Iterator[tuple[str, str | Block]]:
    """("tag", path) and ("block", Block) in page order."""
    stack: list[tuple[str, str, bool, int]] = []  # name, path, outside, main depth
    block, at = Block(), 0

    def opened() -> Block:
        name = stack[-1] if stack else ("", "", False, 0)
        return Block(outside=name[2], main=name[3], path=name[1])

    for match in TOKEN.finditer(page):
        if match.start() > at:
            block.parts.append(page[at : match.start()])
        at = match.end()
        name = (match["name"] or "").lower()
        if not name:
            continue
        if name in INLINE:
            _, hidden = attributes(match["rest"]) if match["rest"] else ("", False)
            if not hidden:
                continue
        if name == "br":
            block.parts.append(" ")
            continue
        if block.parts:
            yield "block", block
        if match["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                yield "tag", "/" + stack[depth][1]
                del stack[depth:]
        else:
            implied = CLOSES.get(name, ()) if name in CLOSES else ("p",) if name in BARRIER or name[0] == "h" else ()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in implied:
                    del stack[i:]
                    break
                if stack[i][0] in BARRIER:
                    break
            words, hidden = attributes(match["rest"]) if match["rest"] else ("", False)
            parent = stack[-1] if stack else ("", "", False, 0)
            main = parent[3]
            if name in MAIN or words and name in ("div", "section", "td") and MAIN_WORDS.search(words):
                main += 1
            outside = hidden or name in OUTSIDE or bool(words and OUTSIDE_WORDS.search(words))
            # an article's own heading may stand in a header element
            if name == "header" and parent[3] and not words:
                outside = False
            if name in ("body", "html", "main"):
                outside = hidden
            path = f"{parent[1]}/{name}" + (f".{words}" if words else "")
            yield "tag", path
            if name not in VOID and not match["rest"].endswith("/"):
                stack.append((name, path, parent[2] or outside, main))
        block = opened()
    if at < len(page):
        block.parts.append(page[at:])
    if block.parts:
        yield "block", block


def code(kind: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}{value}".encode()) - (1 << 63)


def block_code(path: str, text: str) -> int:
    return code("block ", f"{path} {text}")


def page_tokens(page: str) -> dict[int, tuple[int, int]]:
    """Count and first place of every token of a page."""
    found: dict[int, list[int]] = {}
    place = 0
    for kind, item in parse(page):
        if kind == "tag":
            codes = [code("tag ", item)]
        elif item.main and not item.outside:
            codes = [block_code(item.path, item.text())]
        else:
            codes = [code("word ", f"{item.path} {w}") for w in item.text().split()]
        for c in codes:
            found.setdefault(c, [0, place])[0] += 1
            place += 1
    return {c: (n, first) for c, (n, first) in found.items()}


def extract(page: str, template: list[int]) -> str:
    """The data of the page's slots that hold the main text.

    ``template`` are the host's template tokens in order. A token of the page
    counts as template if it continues that order; the words between are data.
    """
    order = {c: i for i, c in enumerate(template)}
    slots: list[tuple[bool, bool, str]] = []  # in main, outside, text
    framed: list[int] = []  # slots that are template text inside the main element
    last = -1
    for kind, item in parse(page):
        if kind == "tag":
            last = max(last, order.get(code("tag ", item), -1))
            continue
        text = item.text()
        if item.main and not item.outside:
            at = order.get(block_code(item.path, text), -1)
            framed += [len(slots)] if at > last else []
            last = max(last, at)
            slots.append((True, False, text))
            continue
        data = []
        for word in text.split():
            at = order.get(code("word ", f"{item.path} {word}"), -1)
            if at > last:
                last = at
            else:
                data.append(word)
        slots.append((False, item.outside, " ".join(data)))
    size = sum(len(text) for main, _, text in slots if main)
    if 2 * sum(len(slots[i][2]) for i in framed) <= size:
        for i in framed:
            slots[i] = (True, False, "")
    inside = any(main and text for main, _, text in slots)
    kept = (t for main, outside, t in slots if t and (main if inside else not outside))
    return " ".join(kept)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.coalesce(host, F.lit(""))


def tokens_of(page: Column) -> Column:
    @F.arrow_udf("array<struct<token:bigint,n:int,place:int>>")
    def tokens(pages: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int32()), ("place", pa.int32())]))
        found = (page_tokens(raw.decode()) for raw in raw_texts(pages))
        return pa.array([[(c, n, at) for c, (n, at) in f.items()] for f in found], kind)

    return tokens.asNondeterministic()(page)


def host_templates(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``host, template``: the ordered template tokens of every host.

    Copies of a page on a host count as one page, as what they have in common
    is their own text. One row per host and token first (added up within
    tasks), then one row per class. A template is no longer than the tokens that occur once on at least
    MIN_SHARE of the pages, so it is bounded by the length of a page.
    """
    base = pages.select(
        host_of(F.col(url)).alias("host"), F.xxhash64(page).alias("page_code"), F.col(page).alias("page")
    )
    copies = materialise(base.groupBy("host", "page_code").agg(F.count("*").alias("n")), "page-codes")
    size = copies.groupBy("host").agg(F.count("*").alias("pages"))
    # stored, so that its size is known: where few pages have copies, none are dealt out
    repeated = materialise(copies.where("n > 1").drop("n"), "copied-pages")
    once = base.join(repeated, ["host", "page_code"], "left_anti").unionByName(
        base.join(repeated, ["host", "page_code"], "left_semi").dropDuplicates(["host", "page_code"])
    )
    occurrences = once.select("host", "page_code", F.explode(tokens_of(F.col("page"))).alias("t"))
    vectors = occurrences.groupBy("host", F.col("t.token").alias("token")).agg(
        F.count("*").alias("support"),
        F.max("t.n").alias("most"),
        F.bit_xor(F.xxhash64("page_code", "t.n")).alias("vector"),
        F.avg("t.place").alias("place"),
    )
    single = vectors.join(size, "host").where(
        (F.col("most") == 1)
        & (F.col("support") >= MIN_PAGES)
        & (F.col("support") >= MIN_SHARE * F.col("pages"))
    )
    classes = single.groupBy("host", "vector", "support").agg(
        F.collect_list(F.struct("place", "token")).alias("members")
    )
    valid = classes.where(F.size("members") >= MIN_TOKENS).groupBy("host").agg(
        F.collect_list(F.struct("support", "members")).alias("classes")
    )
    return valid.select("host", nested(F.col("classes")).alias("template"))


def nest(classes: list[list[tuple[float, int]]]) -> list[int]:
    """The tokens of nested classes in order, the classes given by importance."""
    taken: list[tuple[float, int]] = []
    for members in classes:
        low, high = min(members), max(members)
        if bisect.bisect_left(taken, low) == bisect.bisect_left(taken, high):
            at = bisect.bisect_left(taken, low)
            taken[at:at] = sorted(members)
    return [token for _, token in taken]


def nested(classes: Column) -> Column:
    @F.arrow_udf("array<bigint>")
    def order(hosts: pa.Array) -> pa.Array:
        found = []
        for host in hosts.to_pylist():
            parts = [(-c["support"], sorted((m["place"], m["token"]) for m in c["members"])) for c in host]
            found.append(nest([members for _, members in sorted(parts)]))
        return pa.array(found, pa.list_(pa.int64()))

    return order(classes)


def main_text(pages: DataFrame, url: str = "url", page: str = "html", name: str = "main_text") -> DataFrame:
    """``pages`` with a column ``name``, the main text of each page (in place of
    a column of that name)."""

    @F.arrow_udf("string")
    def read(htmls: pa.Array, templates: pa.Array) -> pa.Array:
        both = zip(raw_texts(htmls), templates.to_pylist(), strict=True)
        return pa.array([extract(raw.decode(), t or []) for raw, t in both], pa.string())

    host, template = private("host"), private("template")
    # stored, so that its size is known when the join is planned
    templates = materialise(host_templates(pages, url, page), "templates").withColumnsRenamed(
        {"host": host, "template": template}
    )
    joined = pages.join(templates, host_of(F.col(url)) == F.col(host), "left")
    return joined.withColumn(name, read(F.col(page), F.col(template))).drop(host, template)


@query()
def op7_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = main_text(pages, name="text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
