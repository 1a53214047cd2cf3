"""Source rows to records, and records put together."""

from pyspark.sql import functions as F

from diskloom.operators import assembly as A
from diskloom.operators import importing as P


def rows(df):
    return {tuple(r) for r in df.collect()}


def ask(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_titles_taken_apart(spark):
    assert ask(spark, P.joined_titles, "A & Cyber II & Ark - Doh", "Copy & Utility Disk", "Lizard 1 & 2 & Editor", "Wizard 1 & 2 Collection", "X & 2 Others", "One", "Engine, The & Big & Y", None) == [["A", "Cyber II", "Ark - Doh"], [], ["Lizard 1 & 2", "Editor"], [], [], [], ["The Engine", "Big", "Y"], None]
    assert ask(spark, lambda c: P.listed_titles(c, ["menu", "compact"]), "B-Oh Menu - Elim - Neb", "QRS Compact - Quad & Carrier", "Brain Wave - The Party", "X Menu") == [["Elim", "Neb"], ["Quad", "Carrier"], [], []]
    assert ask(spark, P.title_case, "BOLD ADVENTURE II", "THE LORD OF THE F16", "B.O.L.D. V.2.31", "QRSTC'S PC", "Mixed CASE") == ["Bold Adventure II", "The Lord of the F16", "B.O.L.D. v2.31", "QRSTC's PC", "Mixed CASE"]
    assert [tuple(r) for r in ask(spark, P.item_parts, "Zork (A) (needs 1MB)", "(some docs)", "Tool (utility)", "Game w/ docs", "Plain")] == [("Zork", "game", "disk a, needs 1MB"), ("some docs", "doc", ""), ("Tool", "utility", ""), ("Game", "game", "with docs"), ("Plain", "game", "")]


def test_parts_and_pages(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "Demo"), (2, 1, "_4A"), (2, 2, ""), (2, 3, "x y"), (3, 1, "?"), (4, 1, "A"), (4, 2, "a")], "m int, o int, part string")
    assert {(r.m, r.o): r.final_part for r in P.positional_parts(df, ["m"], "part", ["o"]).collect()} == {(1, 1): "A", (1, 2): "DEMO", (2, 1): "A", (2, 2): "", (2, 3): "C", (3, 1): "", (4, 1): "A", (4, 2): "B"}
    disks = spark.createDataFrame([(1, 1, 5, None, None, "b", False), (2, 1, None, None, None, None, False), (3, 1, 5, None, None, "A", False), (4, 2, 1, None, None, None, True), (5, 2, None, None, None, None, True), (6, 2, 9, None, None, None, True)], "id int, s int, number int, issue string, version string, part string, d boolean")
    assert {r.id: (r.place, r.page) for r in P.listing_pages(disks, ["s"], F.col("d"), "id", 2).collect()} == {2: (0, 1), 3: (1, 1), 1: (2, 2), 6: (0, 1), 4: (1, 1), 5: (2, 2)}


def test_cascades(spark):
    listed = spark.createDataFrame([("a", "Alpha", "st"), ("beta", "Beta", "amiga")], "id string, name string, platform string")
    df = spark.createDataFrame([(1, "r", "Alpha", "st"), (2, "", "ALPHA!", "st"), (3, None, "Beta", "st"), (4, "", "Gamma Ray", "st")], "i int, rule string, name string, platform string")
    got = P.resolve_series(df, F.col("rule"), listed, "name", "platform")
    assert rows(got.select("i", "series_id", "how")) == {(1, "r", "rule"), (2, "a", "name"), (3, "beta-st", "registered"), (4, "gamma-ray", "registered")}
    dated = spark.createDataFrame([("g", "", "1980", 1), ("g", "B", None, 2), ("g", "C", "1990", 3)], "g string, p string, d string, i int")
    assert rows(P.first_by_date(dated, ["g"], "p", "d", "i")) == {("g", "C")}
    m = spark.createDataFrame([("a", "zip", False), ("b", "raw", False), ("c", "lzh", False), ("d", "zip", True), ("e", "raw", False)], "member string, kind string, current boolean")
    look = lambda *v: spark.createDataFrame(list(v), "member string, target string")
    assert rows(P.place_members(m, look(("a", "h"), ("c", "h"), ("d", "h")), look(("a", "r"), ("b", "r"), ("c", "r"), ("d", "r")), look(("b", "n"), ("c", "n"), ("e", "n")))) == {("a", "h", "hash"), ("b", "n", "name"), ("c", "r", "series"), ("d", "r", "series"), ("e", "n", "name")}
    files = spark.createDataFrame([("l", 1, "Dir/a.zip"), ("l", 2, "x/b.zip"), ("l", 3, "c.zip")], "listing string, ord int, path string")
    assert {r.path for r in P.repair_paths(files, "flat").collect()} == {"Dir/a.zip", "Dir/b.zip"} and {r.path for r in P.repair_paths(files, "folders").collect()} == {"a/a.zip", "b/b.zip"}
    assert ask(spark, lambda c: P.image_in_zip(c, F.lit("st"), ["adf", "msa"]), "Top [ADF]/Sub [x]/Game (1).zip", "d/G.ZIP", "d/G.st") == ["Game (1).adf", "G.st", None]


def test_groups_and_links(spark):
    r = spark.createDataFrame([("A", "st"), ("A", "st"), ("A", "amiga"), ("", "st")], "crew string, platform string")
    assert {(x.crew, tuple(sorted(x.platforms.items())), x.n) for x in P.release_counts(r, "crew", "platform").collect()} == {("A", (("amiga", 1), ("st", 2)), 3)}
    m = spark.createDataFrame([(1, "zed", True), (1, "Amy", False), (1, "bob", True), (1, "bob", False)], "g int, name string, is_current boolean")
    assert P.members_in_order(m, "g").first().members == ["bob", "zed", "Amy"]
    packs = spark.createDataFrame([(1,), (2,), (3,)], "pack_id long")
    got = P.pack_contents(packs, spark.createDataFrame([(1, 7, 2), (1, 8, 1)], "pack_id long, member_id long, position int"), spark.createDataFrame([(3,)], "pack_id long"))
    assert {(x.pack_id, tuple(x.members)) for x in got.collect()} == {(1, (8, 7)), (3, ())}
    links = spark.createDataFrame([("H", "/a/b.zip", 1), ("H", "a/b.zip", 2), ("H", "c.txt", 1), ("Q", "d.zip", 1), ("H", "s.zip", 3)], "link_class string, parameter string, production_id long")
    out = P.download_links(links, spark.createDataFrame([("H", "host", "http://h/")], "link_class string, provider string, base string"), spark.createDataFrame([("http://h/s.zip", 5)], "url string, size long"), [".zip"], 100)
    assert rows(out) == {(1, "host", "http://h/a/b.zip", None)}
    index = spark.createDataFrame([(1, "Zork"), (1, "Yak")], "disc int, title string")
    assert rows(P.missing_titles(index, spark.createDataFrame([(1, "ZORK!")], "disc int, title string"), "disc").select("title")) == {("Yak",)}
    f = spark.createDataFrame([("m", 1, "", "", "d", "A-1", ".adf", "01", 512, "p1"), ("m", 1, "", "", "d", "a 1", ".adf", "01", 512, "p2"), ("", None, "", "", "d", "B", ".adf", "02", 100, "p3"), ("", None, "", "", "d", "b", ".zip", "03", 5, "p4")], "series_id string, number int, part string, version string, folder string, stem string, suffix string, crc32 string, size long, path string")
    assert {(tuple(x.images), tuple(x.paths)) for x in P.group_files(f).collect()} == {(("01",), ("p1", "p2")), ((), ("p3", "p4"))}
    t = spark.createDataFrame([("t1", "Skid 1"), ("t2", "Pack 2"), ("t3", "none")], "path string, stem string")
    pf = spark.createDataFrame([("f1", "pack_2", "", ".adf"), ("f2", "Pack 2", "", ".adf"), ("f3", "Pack 2", "[b]", ".adf")], "path string, stem string, flags string, suffix string")
    assert rows(P.place_texts(t, spark.createDataFrame([("t1", "D1")], "path string, target string"), pf)) == {("t1", "D1", "series"), ("t2", "f1", "name"), ("t2", "f2", "name")}
    e = P.enrich_by_header(spark.createDataFrame([("h", ["a", "b"]), ("i", ["a"])], "header string, contents array<string>"), spark.createDataFrame([("h", ["x"], True, 1), ("i", ["p", "q"], False, 1), ("i", ["r", "s"], True, 2), ("i", ["t"], True, 3)], "header string, contents array<string>, complete boolean, ord int"))
    assert {(x.header, tuple(x.contents)) for x in e.collect()} == {("h", ("a", "b")), ("i", ("r", "s"))}
    pics = spark.createDataFrame([("Zork (USA)", "snap"), ("Zork", "snap"), ("Zork (EU)", "title")], "name string, kind string")
    assert rows(P.best_pictures(pics)) == {("zork", "snap", "Zork"), ("zork", "title", "Zork (EU)")}


def test_assembly(spark):
    d = spark.createDataFrame([(1, 1, "", "m", False), (1, 2, "c", "x", True)], "k int, o int, crc string, md5 string, bad boolean")
    assert rows(A.filled_dumps(d, ["k"], ["crc", "md5"], ["bad"], ["o"])) == {(1, "c", "m", True)}
    c = spark.createDataFrame([("G", 1, "", "n1", ["a", " b"]), ("G", 2, "1989", "n1", ["b", "c"]), ("H", 1, "", "", None)], "name string, o int, founded string, notes string, members array<string>")
    assert {(x.name, x.founded, x.notes, tuple(x.members)) for x in A.crew_rows(c, ["name"], ["o"]).collect()} == {("G", "1989", "n1", ("a", "b", "c")), ("H", "", "", ())}
    loc = spark.createDataFrame([(1, 1, "AA", ""), (1, 2, "", "x.msa"), (1, 3, "", ""), (2, 4, "aa", "")], "disk_id int, location_id int, hash_value string, image_name string")
    img = spark.createDataFrame([(1, 10, 1, "X.st", "aa", "", "", ""), (1, 11, 2, "y.st", "", "", "", "")], "disk_id int, image_id int, ord int, name string, md5 string, sha1 string, sha512 string, crc32 string")
    assert rows(A.location_images(loc, img)) == {(1, 10), (2, 10)}
    want = spark.createDataFrame([(1, "st", "Engine, The (Demo)"), (2, "st", "Nothing")], "item_id int, platform string, title string")
    have = spark.createDataFrame([(5, 50, "st", "The Engine", True), (6, 60, "amiga", "The Engine", True), (7, 70, "st", "Engine, The", False)], "disk_id long, content_id long, platform string, title string, single boolean")
    assert rows(A.title_targets(want, have)) == {(1, 5, 50), (1, 5, None), (1, 7, 70)}
    notes = spark.createDataFrame([(1, 1, 50, "article", "Zork"), (2, 1, 51, "article", "ZORK "), (3, 1, None, "note", "Own note."), (4, 1, None, "note", "New"), (5, 1, None, "note", "New"), (6, 1, None, "note", " ")], "id int, disk_id int, content_id int, kind string, text string")
    out = A.distinct_notes(notes, spark.createDataFrame([(50, "doc"), (51, "game")], "content_id int, kind string"), spark.createDataFrame([(1, "own note\nother")], "disk_id int, notes string"))
    assert rows(out.select("content_id", "kind", "text")) == {(51, "article", "Zork"), (None, "note", "New")}
    media = spark.createDataFrame([(1, None, "u", 2), (1, None, "u", 1), (1, 5, "u", 1)], "disk_id int, content_id int, url string, rank int")
    assert A.distinct_media(media, ["rank"]).count() == 2
    places = spark.createDataFrame([(1, "HTTP://a/b%20c", "", 5, 1), (1, "http://a/b c", "", 3, 2)], "disk_id int, url string, member string, priority int, location_id int")
    assert [r.location_id for r in A.distinct_locations(places).collect()] == [2]


def test_names_of_discs(spark):
    df = spark.createDataFrame([("grp", "Ser", "cr", "pub", True), ("", "Ser", "cr", "pub", True), ("", "", "cr", "pub", False), ("", "", "", "pub", False), ("", "", "", "", False), ("", "", "x", "", True)], "g string, n string, c string, p string, s boolean")
    assert [r[0] for r in df.select(A.disc_crew(*(F.col(c) for c in "gncps"))).collect()] == ["grp", "Ser", "cr", "pub", "Unknown crew", "Unknown crew"]
    lab = spark.createDataFrame([("{name} {number}{part_suffix}", "Menu", 5, "B", "", ""), ("", "", None, "B", "", "Zork"), ("", "", None, "", "", ""), ("", "", None, "B", "", "Zork B")], "t string, n string, k int, p string, v string, tidy string")
    assert [r[0] for r in lab.select(A.disc_label(*(F.col(c) for c in ("t", "n", "k", "p", "v", "tidy")))).collect()] == ["Menu 5 B", "Zork B", "Untitled disk", "Zork B"]
    g = spark.createDataFrame([("SR", "amiga", "Big Fish"), ("SR", "", "Star Race"), ("TRIO", "", "Trio")], "tag string, platform string, full string")
    r = spark.createDataFrame([("SR - TRIO", "amiga"), ("SR", "st"), ("Other", "st")], "crew string, platform string")
    assert {(x.crew, x.expanded) for x in A.expand_groups(F.col("crew"), g, r, "platform").collect()} == {("SR - TRIO", "Big Fish - Trio"), ("SR", "Star Race"), ("Other", "Other")}
    local = spark.createDataFrame([(1, "/f", True, 0)], "disk_id int, path string, bad boolean, rank int")
    online = spark.createDataFrame([(1, "u2", False, 1, 9), (1, "u1", False, 1, 5)], "disk_id int, url string, bad boolean, rank int, priority int")
    assert [r.ref for r in A.ranked_sources(local, online).orderBy("place").collect()] == ["u1", "u2", "/f"]
