"""Relational operators on small tables; their whole-table runs are held against SQL by the query check."""

from datetime import datetime as D

from pyspark.sql import functions as F

from diskloom.operators import relational as R


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_merging_values(spark):
    df = spark.createDataFrame([("k", 2, 1, "", "n2"), ("k", 1, 2, "x", "n1"), ("k", 1, 3, "y", "n2"), ("q", 1, 1, None, " ")], "k string, p int, s int, v string, n string")
    assert rows(R.first_present(df, ["k"], ["v"], ["p", "s"])) == {("k", "x"), ("q", "")}
    assert rows(R.joined_distinct(df, ["k"], "n", ["p", "s"])) == {("k", "n1\nn2")}
    assert {r.v for r in R.best_source_rows(df, ["k"], "p", ["v"], ["s"]).collect()} == {"x", "y", None}
    dates = spark.createDataFrame([("k", 1, "1990", ""), ("k", 2, "1991-05", ""), ("q", 1, "1990-01-01", "1989"), ("z", 1, "19xx", None)], "k string, s int, date string, released string")
    assert {(r.k, tuple(r.date)) for r in R.most_precise_date(dates, ["k"], ["released", "date"], ["s"]).collect()} == {("k", (1991, 5, None)), ("q", (1989, None, None))}


def test_votes(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "a"), ("q", "z"), ("q", "y")], "k string, v string")
    assert rows(R.vote(df, ["k"], "v")) == {("k", "a", 2), ("q", "y", 1)}
    w = spark.createDataFrame([("k", "a", 95), ("k", "b", 5), ("q", "a", 5), ("r", "a", 8), ("r", "b", 12)], "k string, c string, w int")
    assert rows(R.dominant(w, ["k"], "c", "w")) == {("k", "a", 95, 100)}
    assert rows(R.sole_owner(df, "v", "k")) == {("a", "k"), ("b", "k"), ("y", "q"), ("z", "q")}
    kinds = spark.createDataFrame([(1, "doc"), (1, "doc"), (1, "demo"), (2, "doc"), (3, "demo"), (3, "game"), (4, "zzz")], "d int, kind string")
    assert rows(R.majority(kinds, ["d"], "kind", {"game": "G", "demo": "D"}, {"doc": "G"}, ["G", "D"])) == {(1, "D"), (2, "G"), (3, "G")}


def test_match_in_order(spark):
    probes = spark.createDataFrame([(1, "AA", "x", 1), (2, "", "x", 1), (3, None, "x", None), (4, "zz", "", 1)], "p long, md5 string, crc string, size long")
    targets = spark.createDataFrame([(10, "aa", "q", 1, True), (11, "aa", "q", 1, False), (12, "", "X", 1, False)], "t long, md5 string, crc string, size long, bad boolean")
    got = R.match_in_order(probes, "p", targets, [({"md5": "md5"}, "md5"), ({"crc": "crc", "size": "size"}, "crc")], ["bad"], "t")
    assert rows(got) == {(1, 11, "md5"), (2, 12, "crc")} and R.match_in_order(probes.limit(0), "p", targets, [({"md5": "md5"}, "m")], ["bad"], "t").count() == 0


def test_nearest_in_time(spark):
    t = lambda d: D(2020, 1, d)
    probes = spark.createDataFrame([("a", 1, t(5)), ("a", 2, t(1)), ("a", 3, t(30)), ("a", 4, None), ("b", 5, t(5)), ("a", 6, t(4))], "k string, p int, at timestamp")
    targets = spark.createDataFrame([("a", "x", t(3)), ("a", "w", t(3)), ("a", "y", t(7)), ("a", "n", None), ("c", "z", t(5))], "k string, t string, on timestamp")
    got = R.nearest_in_time(probes, targets, ["k"], "at", "on", ["t"])
    assert sorted(map(tuple, R.nearest_in_time(probes, targets, ["k"], "at", "on", ["t"], few=0).collect())) == sorted(map(tuple, got.collect()))
    assert {(r.p, r.nearest_t) for r in got.collect()} == {(1, "w"), (2, "w"), (3, "y"), (6, "w")}


def test_fuzzy_titles(spark):
    titles = spark.createDataFrame([("g", 1, "Xenor 2 - Megablast", 1), ("g", 2, "Calm Machine, The", 2), ("g", 3, "Big Red Dog", 3), ("h", 4, "Xenor II", 1)], "g string, title_id long, title string, ord int")
    probes = spark.createDataFrame([("g", 1, "The Calm Machine (Demo)"), ("g", 2, "Xenor II"), ("g", 3, "Red Cat"), ("h", 4, "xenor ii"), ("g", 5, ""), ("g", 6, None), ("none", 7, "Xenor II")], "g string, probe_id long, title string")
    assert rows(R.fuzzy_titles(probes, titles, "g")) == {(1, 2, "exact"), (2, 1, "words"), (4, 4, "exact")}


def test_prefixes_and_windows(spark):
    urls = spark.createDataFrame([(f"http://a/b/{i}",) for i in range(3)] + [(f"http://a/c/{i}",) for i in range(2)] + [("none",), (None,), ("http://a/b/0",)], "u string")
    got = {r.address: r.prefix for r in R.shared_prefixes(urls, "u", 3).collect()}
    assert got["http://a/b/1"] == "http://a/b/" and got["http://a/c/1"] == "http://a/" and got["none"] == ""
    n = spark.createDataFrame([("k", i) for i in (1, 2, 2, 3, 7, 9, 10)] + [("k", None)], "k string, n int")
    assert rows(R.islands(n, ["k"], "n")) == {("k", 1, 3, 3), ("k", 7, 7, 1), ("k", 9, 10, 2)}
    f = spark.createDataFrame([("k", 1, "a", None), ("k", 2, "", 5), ("k", 3, None, None), ("q", 1, None, None)], "k string, o int, s string, v int")
    assert rows(R.fill_forward(f, ["k"], ["o"], ["s", "v"])) == {("k", 1, "a", None), ("k", 2, "a", 5), ("k", 3, "a", 5), ("q", 1, None, None)}
    assert rows(R.first_n_distinct(n.where("n IS NOT NULL"), ["k"], "n", ["n"], 2)) == {("k", 1, 1), ("k", 2, 2)}


def test_changing_tables(spark):
    old = spark.createDataFrame([(1, "a", ""), (2, "b", ""), (3, "c", "err"), (4, "d", "")], "id int, v string, e string")
    new = spark.createDataFrame([(1, "a", ""), (2, "x", ""), (3, "c", ""), (5, "n", "")], "id int, v string, e string")
    assert rows(R.snapshot_diff(old, new, "id", ["v"], "e")) == {(1, "unchanged"), (2, "changed"), (3, "changed"), (4, "gone"), (5, "new")}
    assert {(r.id, r.v) for r in R.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, "x"), (3, "c"), (4, "d"), (5, "n")}
    files = spark.createDataFrame([("p", "m1"), ("p", "m2"), ("q", "m")], "path string, member string")
    kept, added = R.replace_partition(files, spark.createDataFrame([("p", "m2"), ("p", "m3")], "path string, member string"), "path", "member")
    assert rows(kept) == {("p", "m2"), ("p", "m3"), ("q", "m")} and rows(added) == {("p", "m3")}
    assert R.without_folder(spark.createDataFrame([("/a/b",), ("/ab/c",)], "path string"), "path", "/a").count() == 1
    o = spark.createDataFrame([(1, None)], "id int, v string")
    assert {(r.id, r.v) for r in R.with_overrides(old, "id", o, ["v"]).collect()} == {(1, None), (2, "b"), (3, "c"), (4, "d")}
    assert rows(R.counts_by(old, {"v": F.col("v"), "e": F.col("e")})) == {("v", x, 1) for x in "abcd"} | {("e", "err", 1)}
    assert [r[0] for r in old.select(R.rule_join(old, "v", [("[ab]", "first"), ("b", "second")], "none")).collect()] == ["first", "first", "none", "none"]
