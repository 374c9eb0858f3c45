"""Text functions, chains, families and role views against plain Python."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memspark.engine import channels_of
from memspark.functions import text as t
from memspark.operators import govern, link, plugins
from memspark.operators import temporal as tm


def test_merged_segments(spark):
    def plain(parts, least):
        out = []
        for a, b, x in parts:
            if out and (b - a < least or out[-1][1] - out[-1][0] < least):
                out[-1] = (out[-1][0], b, out[-1][2] + " " + x)
            else:
                out.append((a, b, x))
        return out

    cases = [[], [(0.0, 1.0, "a")], [(0.0, 1.0, "a"), (1.0, 9.0, "b"), (9.0, 10.0, "c")], [(0.0, 6.0, "a"), (6.0, 12.0, "b")]]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, p array<struct<start:double,end:double,text:string>>")
    got = {r.i: [tuple(x) for x in r.m] for r in df.select("i", t.merged_segments(F.col("p"), 5.0).alias("m")).collect()}
    assert got == {i: plain(p, 5.0) for i, p in enumerate(cases)}


def test_time_windows(spark):
    anchor = datetime(2024, 3, 15, 10)
    cases = {"昨天说了什么": ((2024, 3, 14), (2024, 3, 15)), "last week": ((2024, 3, 8), (2024, 3, 15)), "去年": ((2023, 1, 1), (2024, 1, 1)), "last month, on 2023-02-01": ((2023, 2, 1), (2023, 2, 2)), "nothing": None, "": None, None: None}
    df = spark.createDataFrame([(q, anchor) for q in cases], "q string, at timestamp")
    got = {r.q: r.w for r in df.select("q", t.time_window(F.col("q"), F.col("at")).alias("w")).collect()}
    assert {q: w and (tuple(w.start.timetuple()[:3]), tuple(w.end.timetuple()[:3])) for q, w in got.items()} == cases


def test_small_functions(spark):
    row = spark.sql("SELECT '' AS e, CAST(NULL AS STRING) AS n, 'One. Two! Three' AS s").select(
        t.sentences(F.col("s")).alias("some"),
        t.sentences(F.col("e")).alias("none"),
        t.sentences(F.col("n")).alias("null_"),
        t.overlapping_chunks(F.col("e"), 10, 3)["text"].alias("c"),
        t.guarded(F.lit("x" * 30), 20).alias("g"),
        t.category_importance(F.col("n")).alias("i"),
        (t.fingerprint(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))) == t.fingerprint(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))).alias("same"),
    ).first()
    assert row.some == ["One.", "Two!", "Three"] and row.none == [] and row.null_ is None
    assert row.c == [""] and len(row.g) == 20 and row.i == 0.5 and row.same


def test_hash_chain(spark):
    rows = [(c, n, f"{c}{n}" if n % 3 else None) for c in ("a", "b") for n in range(40)]
    out = govern.chained(spark.createDataFrame(rows, "org string, seq long, body string").repartition(5), "org", "seq", "body", {"a": "head"})
    want, digest = [], {"a": "head", "b": ""}
    for c, n, x in rows:
        after = hashlib.sha256(f"{digest[c]}\n{c}\n{n}\n{x or ''}".encode()).hexdigest()
        want.append((c, n, digest[c], after))
        digest[c] = after
    assert sorted(map(tuple, out.collect())) == want
    assert govern.broken_links(out.where("org = 'b'")).where("seq > 0").count() == 0


def test_families(spark):
    v = [(k, k - 1 if k % 7 else None) for k in range(30)] + [(100, 99)]
    got = {r.unit_id: r.family for r in tm.families(spark.createDataFrame(v, "unit_id long, supersedes long")).collect()}
    assert got == {**{k: k - k % 7 for k in range(30)}, 100: 100}
    with pytest.raises(Exception, match="ring"):
        tm.families(spark.createDataFrame([(1, 2), (2, 1)], "unit_id long, supersedes long")).collect()


def test_role_view(spark):
    edges = spark.createDataFrame([("a", "b", "x", True), ("b", "c", "x", True), ("c", "a", "x", True), ("a", "c", "y", True), ("c", "d", "y", True), ("a", "e", "x", False)], "src string, dst string, edge_type string, confirmed boolean")
    rules = spark.createDataFrame([("p", "x"), ("q", "x"), ("q", "y")], "duty string, edge_type string")
    seeds = spark.createDataFrame([("a", "a", ["p", "q"])], "root string, node string, duties array<string>")
    got = sorted((r.node, ",".join(r.duties), r.hops) for r in link.role_view(seeds, edges, rules, 5).collect())
    assert got == [("a", "p,q", 0), ("b", "p,q", 1), ("c", "p,q", 2), ("c", "q", 1), ("d", "q", 2)]


def test_plugins_and_channels(spark):
    rows = spark.createDataFrame([(1, k, f"text {k}") for k in range(12)], "g int, n int, x string")
    assert plugins.get("abstractor", "concat")(rows, ["g"], "n", "x", most=3).first().abstract == "text 0；text 1；text 2"
    assert channels_of(None, None, ("bm25",)) == ("bm25",) and channels_of(("keyword", "keyword"), ("bm25",), ()) == ("keyword",)
    with pytest.raises(ValueError):
        channels_of((), ("bm25",), ("bm25",))


def test_question_windows(spark):
    now = datetime(2024, 3, 13, 15, 30)  # a Wednesday
    day = lambda *x: datetime(*x)
    cases = {
        "最近10天": (day(2024, 3, 3, 15, 30), now), "近2星期": (day(2024, 2, 28, 15, 30), now), "前天": (day(2024, 3, 11), day(2024, 3, 12)), "今日": (day(2024, 3, 13), day(2024, 3, 14)),
        "上周": (day(2024, 3, 4), day(2024, 3, 11)), "本周": (day(2024, 3, 11), now), "上月": (day(2024, 2, 1), day(2024, 3, 1)), "本月": (day(2024, 3, 1), now),
        "去年": (day(2023, 1, 1), day(2024, 1, 1)), "今年": (day(2024, 1, 1), now), "明年1月": (day(2025, 1, 1), day(2025, 2, 1)), "今年3月": (day(2024, 3, 1), day(2024, 4, 1)),
        "今年13月": (day(2024, 1, 1), now), "最近1000000000天": None, "最近99999999999999999999999999天": None, "2023年6月8日": (day(2023, 6, 8), day(2023, 6, 9)), "6月8号": (day(2024, 6, 8), day(2024, 6, 9)), "2月30日": None,
        "他叫什么名字,昨天": None, "": None, "last month": (day(2024, 2, 1), day(2024, 3, 1)), "最近3天,昨天": (day(2024, 3, 10, 15, 30), now),
    }
    df = spark.createDataFrame([(q, now) for q in cases], "q string, now timestamp")
    got = {r.q: r.w and (r.w.start, r.w.end) for r in df.select("q", t.question_window(F.col("q"), F.col("now")).alias("w")).collect()}
    assert got == cases
