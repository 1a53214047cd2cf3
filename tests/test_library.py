"""Scans, matches, links and corrections on small tables."""

import zipfile

from pyspark.sql import functions as F

from diskloom.operators import library as L
from diskloom.sources import files


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_scan_plan_and_store(spark, tmp_path):
    known = spark.createDataFrame([("/a/1", 5, 1, ""), ("/a/2", 5, 1, ""), ("/a/3", 5, 1, "bad"), ("/a/4", 5, 1, ""), ("/b/5", 5, 1, "")], "path string, size long, mtime long, error string")
    found = spark.createDataFrame([("/a/1", 5, 1), ("/a/2", 6, 1), ("/a/3", 5, 1), ("/a/6", 1, 1)], "path string, size long, mtime long")
    plan = L.plan_scan(known, found, ["/b"])
    assert rows(plan) == {("/a/1", "skip"), ("/a/2", "read"), ("/a/3", "read"), ("/a/4", "remove"), ("/b/5", "keep"), ("/a/6", "read")}
    assert dict(rows(L.plan_scan(known, found, cancelled=True)))["/a/4"] == "keep"
    kept = L.store_scan(known.select("path"), plan, spark.createDataFrame([("/a/2",), ("/a/6",)], "path string"))
    assert sorted(r.path for r in kept.collect()) == ["/a/1", "/a/2", "/a/6", "/b/5"]


def test_index_and_match(spark, tmp_path):
    raw = bytes(737_280)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("Lost Quest (1990)(Acme)[cr X].st", raw)
    (tmp_path / "note.st").write_bytes(b"x")
    entries = L.index_files(files.scan(spark, str(tmp_path))).withColumn("id", F.xxhash64("path", "member"))
    got = {r.display_name: r for r in entries.collect()}
    assert set(got) == {"Lost Quest [cr X]", "note"} and got["Lost Quest [cr X]"].format == "st" and got["note"].error
    images = spark.createDataFrame([(1, 7, True, 0, got["Lost Quest [cr X]"].md5, "", "", "", 0), (2, 8, False, 1, "", got["Lost Quest [cr X]"].sha1.upper(), "", "", 0), (3, 9, False, 0, got["Lost Quest [cr X]"].md5, "", "", "", 0)], "image_id long, disk_id long, bad boolean, rank int, md5 string, sha1 string, sha512 string, crc32 string, size long")
    assert rows(L.match_entries(entries, images).select("image_id", "attempt")) == {(3, "md5")}


def test_kept_links(spark):
    matched = spark.createDataFrame([("p", "", "AA", "", None), ("q", "", "bb", "", None), ("r", "", "cc", "", 5)], "path string, member string, sha1 string, raw_sha1 string, disk_id long")
    kept = spark.createDataFrame([("p", "", "aa", 1), ("q", "", "zz", 2), ("r", "", "cc", 3)], "path string, member string, sha1 string, kept_disk long")
    assert rows(L.with_kept_links(matched, kept).select("path", "disk_id")) == {("p", 1), ("q", None), ("r", 5)}


def test_discs_across_snapshots(spark):
    disk = "id long, platform string, series_id string, number int, part string, version string"
    image = "image_id long, disk_id long, bad boolean, rank int, md5 string, sha1 string, sha512 string, crc32 string, size long"
    old = spark.createDataFrame([(1, "st", "m", 1, "", ""), (2, "st", "", None, "", ""), (3, "st", "m", 9, "", ""), (4, "amiga", "", None, "", "")], disk)
    dumps = spark.createDataFrame([(1, 2, False, 0, "aa", "", "", "", None), (2, 3, False, 0, "", "", "", "01", 5), (3, 4, False, 0, "aa", "", "", "", None)], image)
    new = spark.createDataFrame([(11, "st", "m", 1, "", ""), (12, "st", "", None, "", ""), (13, "st", "m", 10, "", "")], disk)
    new_dumps = spark.createDataFrame([(1, 12, False, 0, "AA", "", "", "", None), (2, 13, False, 0, "", "", "", "01", 5)], image)
    wanted = L.identities(old, dumps).withColumn("key", F.col("disk_id"))
    assert rows(L.find_discs(wanted, new, new_dumps)) == {(1, 11), (2, 12), (3, 13), (4, None)}


def test_corrections(spark):
    disks = spark.createDataFrame([(1, "Label", "T", "P", "", "C", "", 1990, None, None), (2, "Other", "", "", "", "", "", None, None, None)], "id long, label string, title string, publisher string, cracker string, crew string, notes string, year int, month int, day int")
    form = spark.createDataFrame([(1, "label", " New  label "), (1, "publisher", "P"), (1, "date", "1990-06"), (2, "label", "  "), (2, "date", "1990-02-30"), (2, "crew", "X"), (2, "size", "1")], "disk_id long, field string, value string")
    good, bad = L.corrections_from_form(disks, form)
    assert rows(good) == {(1, "label", "New label"), (1, "date", "1990-06"), (2, "crew", "X")} and {(r.disk_id, r.field) for r in bad.collect()} == {(2, "label"), (2, "date")}
    got = {r.id: (r.label, r.year, r.month, r.crew) for r in L.corrected_discs(disks, good).collect()}
    assert got == {1: ("New label", 1990, 6, "C"), 2: ("Other", None, None, "X")}
    left = L.store_corrections(good, spark.createDataFrame([(1,)], "disk_id long"), L.empty(spark, "disk_id long, field string, value string"))
    assert rows(left) == {(2, "crew", "X")}
    contents = spark.createDataFrame([(1, 1, 1, "A"), (2, 1, 2, "A"), (3, 1, 3, "B")], "id long, disk_id long, position int, title string")
    renamed = spark.createDataFrame([(1, "A", 2, "A two")], "disk_id long, title string, occurrence int, value string")
    assert rows(L.corrected_titles(contents, renamed).select("id", "title")) == {(1, "A"), (2, "A two"), (3, "B")}


def test_choices(spark):
    copies = spark.createDataFrame([("/long/path.st", "", 1, 10), ("/a.zip", "m", 1, 11), ("/b.st", "", 1, 11), ("/c", "", None, 10), ("/d.st", "", 2, None)], "path string, member string, disk_id long, image_id long")
    images = spark.createDataFrame([(10, True, 0), (11, False, 1)], "image_id long, bad boolean, rank int")
    assert rows(L.best_copies(copies, images).select("disk_id", "path")) == {(1, "/b.st"), (2, "/d.st")}
    downloads = spark.createDataFrame([(1, "aa", "bb"), (2, "aa", "bb"), (3, "x", "y")], "download_id long, md5 string, sha1 string")
    expected = spark.createDataFrame([(1, "MD5", "AA"), (2, "md5", "aa"), (2, "sha1", "zz"), (3, "sha256", "q")], "download_id long, kind string, value string")
    assert rows(L.verify_downloads(downloads, expected)) == {(1, ""), (2, "sha1"), (3, "unchecked")}
    contents = spark.createDataFrame([(i, 1, i, t) for i, t in enumerate(["A", "B", "C", "D", "E", "F", "G", "a", "H"])], "id long, disk_id long, position int, title string")
    matched = spark.createDataFrame([(1, "h")], "disk_id long, title string")
    assert rows(L.contents_summary(contents, matched)) == {(1, "A, B, C, D, E, H and 2 more")}
    articles = spark.createDataFrame([(1, "crew", "Gang", "c"), (1, "title", "Quest", "t"), (1, "disc", "quest", "d")], "disk_id long, about string, title string, url string")
    assert rows(L.summary_articles(spark.createDataFrame([(1,)], "disk_id long"), articles)) == {(1, 1, "Quest", "t"), (1, 2, "Gang", "c")}


def test_history(spark):
    s, i = "id long, started string, finished string", "session_id long, at int, name string, status string"
    sessions, items = L.empty(spark, s), L.empty(spark, i)
    for n in (1, 2, 2):
        sessions, items = L.record_session(sessions, items, spark.createDataFrame([(n, f"2020-0{n}", "x")], s), spark.createDataFrame([(n, 0, "a", "done"), (n, 1, "b", "failed")], i))
    got = L.recent_sessions(sessions, items, 5).collect()
    assert [(r.id, r.done, r.failed, r.lines) for r in got] == [(2, 1, 1, ["a: done", "b: failed"]), (1, 1, 1, ["a: done", "b: failed"])]
