"""Details of discs, virus reports, links of files, records of two databases, searches of unmatched files."""

from pyspark.sql import functions as F

from diskloom.operators import assembly as A
from diskloom.operators import boot as B
from diskloom.operators import library as L
from diskloom.operators import menus as M
from diskloom.plans import detail as D
from diskloom.plans.find import Page


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


def test_media_locations_trivia(spark):
    prefixes = spark.createDataFrame([(1, "https://a/"), (2, "https://b/p/")], "id long, text string")
    credits = spark.createDataFrame([(1, "s", "By {page} {{x}}"), (2, "t", "lone { brace")], "id long, source string, credit string")
    media = [(1, 5, None, "snap", 2, 1, "x.png", 2, "page", None, None, 1), (2, 5, 9, "snap", 1, 1, "y.png", None, None, 1, "t.png", 2), (3, 5, 9, "snap", 3, 1, "x.png", None, None, None, None, 2), (4, 5, None, "snap", 1, 99, "z", None, None, None, None, 1)]
    df = spark.createDataFrame(media, "id long, disk_id long, content_id long, kind string, rank int, url_prefix long, url_rest string, page_prefix long, page_rest string, thumb_prefix long, thumb_rest string, credit_id long")
    assert rows(D.media_rows(df, prefixes, credits), "id", "url", "page_url", "thumb_url", "source", "credit") == [(1, "https://a/x.png", "https://b/p/page", "", "s", "By b/p/page {x}"), (2, "https://a/y.png", "", "https://a/t.png", "t", "lone { brace")]
    line = spark.createDataFrame([("By a {b} at h/p", "https://h/p"), ("plain", None)], "c string, p string").select(D.credit_template(F.col("c"), F.col("p")).alias("t"), "p")
    assert rows(line.select("t", D.media_credit(F.col("t"), F.col("p")))) == [("By a {{b}} at {page}", "By a {b} at h/p"), ("plain", "plain")]
    locations = spark.createDataFrame([(7, 1, "f.zip", 2, None), (8, 2, None, None, None)], "id long, url_prefix long, url_rest string, page_prefix long, page_rest string")
    assert rows(D.location_rows(locations, prefixes)) == [(7, "https://a/f.zip", "https://b/p/"), (8, "https://b/p/", "")]
    trivia = spark.createDataFrame([(1, 5, 20, "fact", "F"), (2, 5, None, "note", "N"), (3, 5, 10, "wikipedia", "W")], "id long, disk_id long, content_id long, kind string, text string")
    contents = spark.createDataFrame([(10, 2), (20, 1)], "id long, position int")
    assert rows(D.trivia_rows(trivia, contents), "place", "id", "title") == [(1, 2, ""), (2, 1, ""), (3, 3, "W")]
    assert (Page(trivia, 0, 10).pages, Page(trivia, 21, 10).pages) == (1, 3)


def test_pictures_folders_hashes(spark):
    pics = spark.createDataFrame([("A (1990)(X)", "title", "u2"), ("A (1990)(X)", "box", "u1"), ("No date", "box", "u3")], "name string, kind string, url string")
    assert rows(A.pictures_by_dump(pics, ["box", "title"])) == [("A (1990)(X)", [("box", "u1"), ("title", "u2")])]
    urls = spark.createDataFrame([("http://h/1", "b"), ("http://h/1", "a"), ("http://h/2", "a")], "url string, source string")
    assert rows(A.picture_counts(urls, spark.createDataFrame([("http://h/2", 7)], "url string, bytes long"))) == [("a", "h", 1, 7, 1)]
    discs = spark.createDataFrame([(1, "st", "single", False, "", "", "Gang", "P"), (2, "vic", "pack", True, "Crew", "S", "", ""), (3, None, "menu", False, "", "", "", "")], "id long, platform string, kind string, in_series boolean, group_name string, series_name string, cracker string, publisher string")
    got = A.disc_folders(discs, spark.createDataFrame([(1, "Demos")], "disk_id long, category string"), {"st": "Atari ST"}, {"pack": "Demos"}, "Games")
    assert rows(got) == [(1, "Atari ST", "Demos", "Gang"), (2, "vic", "Demos", "Crew"), (3, "Unknown platform", "Games", "Unknown crew")]
    locations = spark.createDataFrame([(1, 9, "md5", "AA"), (2, 9, "md5", "bb"), (3, None, "md5", "aa")], "location_id long, image_id long, hash_kind string, hash_value string")
    images = spark.createDataFrame([(9, "aa", "", "", "")], "image_id long, md5 string, sha1 string, sha512 string, crc32 string")
    assert rows(A.location_hashes(locations, images), "location_id", "hash_value") == [(1, ""), (2, "bb"), (3, "aa")]
    merged = spark.createDataFrame([(1, "new"), (2, "dropped"), (3, "dropped")], "record_id long, way string")
    records = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "record_id long, source string")
    assert rows(A.merge_totals(merged, records)) == [("a", "dropped", 1), ("a", "new", 1), ("b", "dropped", 1)]
    items = spark.createDataFrame([(1, "a"), (2, "a")], "item_id long, source string")
    assert rows(A.unplaced(items, items.where("item_id = 1"))) == [("a", 2, 1)]
    named = spark.createDataFrame([("x", "st"), ("y", "st"), ("", "st"), ("y", "st")], "series_key string, platform string")
    assert rows(A.new_series(named, spark.createDataFrame([("x",)], "id string"))) == [("y", "st", 2)]


def test_from_bytes_to_report(spark):
    sector = bytearray(737280)
    sector[11:13], sector[13], sector[19:21], sector[24], sector[26] = b"\x00\x02", 2, (1440).to_bytes(2, "little"), 9, 2
    idle = bytearray(sector)
    idle[0:2], idle[30:32] = b"\x60\x1c", b"\x4e\x75"

    def runs(raw):
        total = sum(int.from_bytes(raw[i : i + 2], "big") for i in range(0, 510, 2)) & 0xFFFF
        raw[510:512] = ((0x1234 - total) & 0xFFFF).to_bytes(2, "big")
        return bytes(raw)

    files = spark.createDataFrame([(1, "a.st", bytearray(sector)), (2, "b.st", bytearray(runs(idle))), (3, "c.st", bytearray(runs(bytearray(sector)))), (4, "x.txt", bytearray(b"no"))], "id long, name string, content binary")
    blocks = B.inspected_blocks(files)
    assert rows(blocks, "id", "boot_runs", "does_nothing") == [(1, False, False), (2, True, True), (3, True, False)]
    none = spark.createDataFrame([], "ord int, name string, offset int, length int, sha1 string")
    found = B.classify(blocks, none, spark.createDataFrame([], "name string, offset int, bytes string"), spark.createDataFrame([], "boot_crc long, name string, class string"))
    assert rows(found, "id", "status") == [(1, "inactive"), (2, "inactive"), (3, "unknown")]
    used = spark.createDataFrame([(10, 1, 100), (11, 3, 101), (12, None, 102), (13, None, 103)], "disk_id long, entry_id long, image_id long")
    images = spark.createDataFrame([(100, 10, "a", 0, False, "Bug"), (101, 11, "b", 0, False, "Bug"), (111, 11, "b2", 1, False, ""), (102, 12, "c", 0, False, "Ghost"), (103, 13, "d", 0, False, "")], "image_id long, disk_id long, name string, rank int, bad boolean, virus string")
    assert rows(B.disc_reports(used, found, images)) == [(10, "inactive", "", "", ""), (11, "flagged", "Bug", "catalogue", "b2"), (12, "flagged", "Ghost", "catalogue", "")]
    pairs = spark.createDataFrame([("Ghost", "ghost-A 2"), ("Ghost A", "Ghost B"), ("", "x")], "a string, b string")
    assert [r[0] for r in pairs.select(B.same_virus(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_library_reads_and_links(spark):
    entries = spark.createDataFrame(
        [(1, None, "Big Quest", "", "readme", "/a/1.st", "", "aa", "", None, 5, 1, "", "virus", "Bug"), (2, 7, "Big Quest", "", "", "/a/2.zip", "x.st", "bb", "", 3, 5, 1, "", "known", ""), (3, None, "Quest", "VOL", "big", "/b/3.zip", "y.st", "cc", "dd", None, 6, 2, "bad", "", ""), (4, None, "Other", "", "", "/b/3.zip", "z.st", "ee", "", None, 6, 2, "", None, None)],
        "id long, disk_id long, display_name string, label string, listing string, path string, member string, sha1 string, raw_sha1 string, image_id long, size long, mtime long, error string, boot_status string, boot_name string",
    )
    assert [r.id for r in L.search_unmatched(entries, "big qu").collect()] == [1, 3] or {r.id for r in L.search_unmatched(entries, "big qu").collect()} == {1, 3}
    assert [r.id for r in L.search_unmatched(entries, " ").collect()] == [1, 4, 3] and L.search_unmatched(entries, "nothing").count() == 0
    assert rows(L.scanned_files(entries)) == [("/a/1.st", 5, 1, ""), ("/a/2.zip", 5, 1, ""), ("/b/3.zip", 6, 2, "bad")]
    assert [r.id for r in L.infected_entries(entries).collect()] == [1] and rows(L.checked_blocks(entries), "id") == [(1,), (2,)]
    statuses = spark.createDataFrame([(1, "virus", "Bug"), (2, "virus", "New")], "id long, status string, name string")
    assert rows(L.recheck_blocks(entries, statuses, "f2", "f1")) == [(2, "virus", "New")] and L.recheck_blocks(entries, statuses, "f1", "f1").count() == 0
    counts = L.library_counts(entries.withColumn("md5", F.lit("m")).withColumn("raw_md5", F.lit(""))).first()
    assert tuple(counts) == (4, 1, 3, 3, 2)
    kept = spark.createDataFrame([("/a/1.st", "", "old", 1, "")], "path string, member string, sha1 string, kept_disk long, source string")
    wanted = spark.createDataFrame([("/a/1.st", 9, "u"), ("/a/2.zip", 9, "u"), ("/b/3.zip", 9, "u")], "path string, disk_id long, source string")
    linked = L.link_files(kept, entries, wanted)  # the second is matched, the third has two images
    assert rows(linked) == [("/a/1.st", "", "aa", 9, "u")] and L.unlink_files(linked, wanted).count() == 0


def test_relink_once(spark):
    schema = "disk_id long, field string, identity struct<platform:string,series_id:string,number:int,part:string,version:string,hashes:array<struct<md5:string,sha1:string,sha512:string,crc32:string,size:bigint>>>"
    stored = spark.createDataFrame([(1, "x", ("st", "s", 4, "", "", [])), (2, "y", ("st", "", None, "", "", [("aa", "", "", "", 1)])), (3, "z", ("st", "", None, "", "", []))], schema)
    disks = spark.createDataFrame([(50, "st", "s", 4, "", ""), (60, "st", "", None, "", "")], "id long, platform string, series_id string, number int, part string, version string")
    images = spark.createDataFrame([(9, 60, "aa", "", "", "", 1, False, 0)], "image_id long, disk_id long, md5 string, sha1 string, sha512 string, crc32 string, size long, bad boolean, rank int")
    moved, stamp = L.relink(stored, "old", disks, images, "new")
    assert rows(moved, "field", "disk_id") == [("x", 50), ("y", 60), ("z", None)] and stamp == "new"
    assert L.relink(moved, "new", disks, images, "new")[0] is moved


def test_menu_and_scene_records(spark):
    make = spark.createDataFrame
    got = M.menu_discs(
        make([(1, "Zorb Menu")], "id long, name string"), make([(1, 1, 7, None, "2"), (2, 1, None, "Special", None), (3, 99, 1, None, None)], "id long, set_id long, number int, issue string, version string"),
        make([(10, 1, "a", 5, 6, " n "), (11, 1, "b", None, None, None), (12, 2, "_x", None, 77, ""), (13, 3, "", None, None, "")], "id long, menu_id long, part string, condition_id long, donor_id long, notes string"),
        make([(5, "Slightly Damaged")], "id long, name string"), make([(6, "Ann")], "id long, name string"), make([(1, "B", 2), (1, "A", 1)], "set_id long, name string, position int"),
        make([(10, 2, 2, "Two", "game", "Deux"), (10, 1, 1, "One", "game", "")], "disk_id long, id long, position int, title string, kind string, other string"), make([(10, 1, "d.st", "ff", 9)], "disk_id long, id long, name string, sha512 string, size long"),
    )
    assert rows(got, "disk_id", "number", "part", "version", "title", "damaged", "notes", "crews") == [
        (10, 7, "A", "v2", "", True, "n\nDonated by Ann.\nTwo is also known as Deux.", ["A", "B"]), (11, 7, "B", "v2", "", False, "", ["A", "B"]), (12, None, "", "", "Zorb Menu Special_x", False, "", ["A", "B"]),
    ]
    (first,) = [r for r in got.collect() if r.disk_id == 10]
    assert [c.title for c in first.contents] == ["One", "Two"] and [tuple(i) for i in first.images] == [("d.st", "ff", 9)]
    assert rows(M.shown_pictures(make([(1, 5, "PNG"), (1, 4, "exe"), (1, 6, "jpg"), (1, 7, "png")], "game_id long, id long, extension string"), "game_id", most=2), "place", "id") == [(1, 5), (2, 6)]
    index = M.production_index(
        make([(1, "Zorb Menu 12"), (2, "Great Game cracktro"), (3, "Elsewhere"), (4, "Pack #3")], "id long, title string"),
        make([(1, 0, "pc"), (1, 1, "st"), (2, 0, "st"), (3, 0, "pc"), (4, 0, "st")], "production_id long, ord int, platform string"),
        make([(1, "0001menu"), (2, "0002crac"), (4, "0003pack")], "production_id long, path string"), make([(1, 1, "Zorb", True), (1, 0, "Ann", False)], "production_id long, ord int, name string, is_group boolean"), ["st"],
    )
    assert rows(index, "production_id", "platform", "kind", "groups") == [(1, "st", "0001", ["Zorb"]), (2, "st", "0002", []), (4, "st", "0003", [])]
    listed = make([("zorb menu", "st", "zm"), ("zorb zorb menu", "st", "no")], "key string, platform string, series_id string")
    assert rows(M.menu_intros(index, ["0001"], listed)) == [(1, "zm", 12)]
    members = make([(1, 0, 2), (4, 0, 2), (4, 1, 3)], "production_id long, position int, member_id long")
    shots = make([(2, 1, "p2"), (1, 5, "p1")], "production_id long, id long, url string")
    links = make([(4, "u"), (4, "u")], "production_id long, url string")
    discs = {r.production_id: r for r in M.scene_discs(index, members, shots, links, ["0002"], ["0001"]).collect()}
    assert set(discs) == {1, 4} and [tuple(c) for c in discs[1].contents] == [("Great Game cracktro", "game")] and [tuple(c) for c in discs[4].contents] == [("Great Game cracktro", "intro")]
    assert (discs[1].pictures, discs[4].pictures, discs[4].urls) == (["p1", "p2"], ["p2"], ["u"])
