import os.path
import re

from pyspark.sql import functions as F

from quillframe.functions import text as tx

STRINGS = [
    "", "a", "a\n", "a\n\n", "\n", " \x1c a 　", "\x0b", "a\r\nb\rc\x85d e",
    "\x00", " x ", "a.txt", ".profile", "..a", "a.", "a..b", ".a.b", "x/y.TXT",
]


def values(spark, strings, *columns):
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    return df.select("s", *columns).collect()


def test_strip_and_lines_follow_python(spark):
    s = F.col("s")
    for r in values(
        spark, STRINGS, tx.strip(s).alias("st"), tx.split_lines(s).alias("ls"),
        tx.line_count(s).alias("n"), F.regexp_replace(s, tx.WHITESPACE_CLASS, "").alias("w"),
    ):
        assert r.st == r.s.strip()
        assert r.ls == r.s.splitlines()
        assert r.n == len(r.s.splitlines())
        assert r.w == re.sub(r"\s", "", r.s)


def test_extension_follows_splitext(spark):
    for r in values(spark, STRINGS, tx.extension(F.col("s")).alias("e")):
        assert r.e == os.path.splitext(r.s)[1].lower()


def test_size_label(spark):
    sizes = {
        0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1408: "1.4 KB",
        1048576: "1.0 MB", 1310720: "1.2 MB", 5_000_000: "4.8 MB",
    }
    df = spark.createDataFrame([(k,) for k in sizes], "s long")
    for r in df.select("s", tx.size_label(F.col("s")).alias("label")).collect():
        assert r.label == sizes[r.s]


def test_table_name(spark):
    names = {
        "VC Deal Memos": "vc_deal_memos", "/data/in/My File.csv": "my_file_csv",
        "2024 results": "t_2024_results", "--": "dataset", "": "dataset", "ab": "dataset",
        "a/b/": "dataset", "x/deals/": "deals", "abc": "abc", "__A__b__": "a_b",
        "été now": "t_now",
    }
    for r in values(spark, list(names), tx.table_name(F.col("s")).alias("t")):
        if r.s == "été now":
            assert r.t == "t_now"  # 't' is left of the first word
        else:
            assert r.t == names[r.s]


def test_shorten_and_type_name(spark):
    r = values(
        spark, ["x" * 101], tx.shorten(F.col("s"), 100).alias("a"),
        tx.shorten(F.col("s"), 101).alias("b"), tx.type_name(F.lit(".CSV")).alias("t"),
    )[0]
    assert r.a == "x" * 100 + "..." and r.b == r.s and r.t == "csv"


def test_utf8(spark):
    df = spark.createDataFrame([(b"ok \xc3\xa9",), (b"bad \xff",)], "b binary")
    rows = df.select(
        tx.is_utf8(F.col("b")).alias("v"), tx.decode_lossy(F.col("b")).alias("d")
    ).collect()
    assert [r.v for r in rows] == [True, False]
    assert rows[0].d == "ok é" and rows[1].d == "bad �"
