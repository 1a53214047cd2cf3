"""The find query over a small invented catalogue."""

import pytest
from pyspark.sql import functions as F

from diskloom.functions import names as N
from diskloom.plans.catalogue import build_catalogue, locate_snapshot, open_snapshot, write_snapshot
from diskloom.plans.find import Overrides, Query, facets, parse_query, search

SERIES = [("pom", "Pompadour Menus", "atari-st"), ("lem", "Lemmoids", "amiga"), ("q", "Q", "amiga")]
#        id series number part version label platform kind category crew year publisher notes
DISKS = [
    (1, "pom", 1, "", "", "Pompadour Menus 1", "atari-st", "menu", "games", "Pompadour", 1989, "", ""),
    (2, "pom", 2, "A", "", "Pompadour Menus 2 A", "atari-st", "menu", "games", "Pompadour", 1990, "", "scroll with 1"),
    (3, "pom", 2, "B", "", "Pompadour Menus 2 B", "atari-st", "menu", "demos", "Pompadour", None, "", ""),
    (4, "lem", 2, "", "", "Lemmoids 2", "amiga", "menu", "games", "Lemmoids", 1991, "", ""),
    (5, "", None, "", "", "Xenor II", "amiga", "single", "games", "ace", 1988, "Acme", ""),
    (6, "", None, "", "", "Calm Machine, The", "amiga", "single", "games", "Éclair", 1992, "", ""),
    (7, "q", 320, "", "", "Q 320", "amiga", "menu", "games", "Q", 1992, "", ""),
]
CONTENTS = [
    (11, 1, 1, "Xenor 2", "game", ""), (12, 1, 2, "R-Kind", "game", ""), (13, 2, 1, "Lemmoids 2", "game", ""), (14, 3, 1, "Zorb", "demo", "aka Globule"),
    (15, 4, 1, "Xenor", "game", ""), (16, 7, 1, "Airship Q320", "game", ""), (17, 6, 1, "Calm Machine, The", "game", ""),
]


@pytest.fixture(scope="module")
def cat(spark):
    disks = spark.createDataFrame([(*d, "", "", None) for d in DISKS], "id long, series_id string, number int, part string, version string, label string, platform string, kind string, category string, crew string, year int, publisher string, notes string, title string, cracker string, month int")
    disks = disks.withColumn("sort_title", N.sort_title(F.col("label")))
    contents = spark.createDataFrame([(*c, "", "") for c in CONTENTS], "id long, disk_id long, position int, title string, kind string, extra string, publisher string, cracker string")
    images = spark.createDataFrame([(1, 5, "Xenor_II.adf")], "id long, disk_id long, name string")
    locations = spark.createDataFrame([(1, "host"), (5, "other")], "disk_id long, provider string")
    series = spark.createDataFrame(SERIES, "id string, name string, platform string")
    alias = spark.createDataFrame([("Pompadour Menus", "pom"), ("pompadour", "pom"), ("lemmoids", "lem"), ("q", "q")], "alias string, series_id string")
    c = build_catalogue(disks, contents, images, locations, series, alias)
    return c.__class__(**{k: getattr(c, k).cache() for k in c.__dataclass_fields__})


def titles(page):
    return [r.title for r in page.rows.collect()]


def discs(page):
    return [r.disk_id for r in page.rows.collect()]


def test_parse_query():
    table = {"pompadour menus": ["pom"], "q": ["q"]}
    p = parse_query("Pompadour Menus disk 51a v2.0 extra", table)
    assert (p.series_ids, p.number, p.part, p.version, p.words) == (("pom",), 51, "A", "v2", ("extra",))
    assert parse_query("pompadour menus side b", table).number is None
    assert parse_query("q12 part 2", table).part == "B"
    assert parse_query("zorbo2 v8", table).words == ("zorbo2", "v8")


def test_words_prefixes_and_numerals(cat):
    page = search(cat, Query("xenor"))
    assert page.total == 3 and titles(page)[0] == "Xenor"
    both = {"Xenor 2", "Xenor II", "Xenor"}  # the last is on a disc whose label has the number
    assert set(titles(search(cat, Query("xenor 2")))) == both and set(titles(search(cat, Query("xenor2")))) == both
    assert titles(search(cat, Query("rkind"))) == ["R-Kind"]
    assert titles(search(cat, Query("globule"))) == ["Zorb"]
    assert titles(search(cat, Query("the calm machine"))) == ["The Calm Machine"]


def test_substring_only_after_nothing_was_found(cat):
    assert titles(search(cat, Query("enor acme"))) == ["Xenor II"]
    assert search(cat, Query("nosuchthing")).total == 0


def test_disc_references(cat):
    page = search(cat, Query("pompadour 2 b", mode="discs"))
    assert discs(page) == [3]
    assert discs(search(cat, Query("pompadour 2 z", mode="discs"))) == [2, 3]  # no such part: ignored
    rows = search(cat, Query("lemmoids 2")).rows.collect()
    assert rows[0].disk_id == 4 and rows[0].score >= 1000 and {r.disk_id for r in rows} == {2, 4}
    assert all(r.score < 1000 for r in rows if r.disk_id == 2)
    assert 1 not in discs(search(cat, Query("pompadour menus 1", mode="discs")))[1:]


def test_filters_and_availability(cat, spark):
    assert search(cat, Query(platform="atari-st", mode="discs")).total == 3
    assert search(cat, Query(kinds=("single",), mode="discs")).total == 2
    assert search(cat, Query(crew="Pompadour", year=1990, mode="discs")).total == 1
    assert discs(search(cat, Query(available_only=True, mode="discs", sort="disc"), providers=["host"], local_disks=spark.createDataFrame([(3,)], "disk_id long"))) == [1, 3]
    assert search(cat, Query(available_only=True)).total == 0


def test_orders(cat):
    order = lambda s: discs(search(cat, Query(mode="discs", sort=s)))
    assert order("year") == [5, 1, 2, 4, 6, 7, 3]
    assert order("year-desc") == [6, 7, 4, 2, 1, 5, 3]
    assert order("crew") == [5, 4, 1, 2, 3, 7, 6]  # É sorts behind z, ASCII case does not count
    assert order("title") == [6, 4, 1, 2, 3, 7, 5]
    assert order("title-desc") == order("title")[::-1]


def test_pages_join_up(cat):
    whole = search(cat, Query(sort="title", page_size=50)).rows.collect()
    parts = [r for p in range(4) for r in search(cat, Query(sort="title", page=p, page_size=3)).rows.collect()]
    assert parts == whole and len(parts) == 8 and search(cat, Query(page=9)).rows.count() == 0


def test_matched_titles(cat):
    rows = {r.disk_id: r.matched for r in search(cat, Query("xenor", mode="discs")).rows.collect()}
    assert rows == {1: ["Xenor 2"], 4: ["Xenor"], 5: []}


def test_overrides(cat, spark):
    disks = spark.createDataFrame([(5, "Xenor II", "", "Baker Crew", "Acme", "", "", 1990, None)], "id long, label string, title string, crew string, publisher string, cracker string, notes string, year int, month int")
    names = spark.createDataFrame([(12, 1, "Arkitype")], "content_id long, disk_id long, title string")
    o = Overrides(disks, names)
    assert search(cat, Query("baker xenor"), overrides=o).total == 1  # one word corrected, one in the catalogue
    assert titles(search(cat, Query("arkitype"), overrides=o)) == ["Arkitype"]
    assert titles(search(cat, Query("rkind"), overrides=o)) == ["Arkitype"]  # the old name still finds it
    assert search(cat, Query(year=1990, mode="discs"), overrides=o).total == 2
    assert search(cat, Query(crew="ace", mode="discs"), overrides=o).total == 0
    plain, same = (search(cat, Query("xenor"), overrides=x).rows.collect() for x in (None, Overrides()))
    assert plain == same
    got = {(r.facet, r.value): r.n for r in facets(cat, o).collect()}
    assert got["crew", "Baker Crew"] == 1 and ("crew", "ace") not in got and got["year", "1990"] == 2 and got["category", "demos"] == 1


def test_snapshot_round_trip(cat, spark, tmp_path):
    first = write_snapshot(cat, str(tmp_path), {"built_at": "2020"})
    second = write_snapshot(cat, str(tmp_path), {"built_at": "2021"})
    assert locate_snapshot([first, second, str(tmp_path / "none")]) == second
    again = open_snapshot(spark, str(tmp_path))
    assert titles(search(again, Query("xenor"))) == titles(search(cat, Query("xenor")))
    with pytest.raises(ValueError):
        open_snapshot(spark, str(tmp_path / "none"))


def test_rows_and_details(cat, spark):
    from diskloom.plans import detail as D

    rows = D.result_rows(cat, search(cat, Query("xenor", mode="discs")), spark.createDataFrame([(4,)], "disk_id long"), ["host"]).collect()
    assert {r.disk_id: (r.label, r.availability, r.summary) for r in rows} == {4: ("Lemmoids 2", "local", "Xenor"), 1: ("Pompadour Menus 1", "online", "Xenor 2, R-Kind"), 5: ("Xenor II", "none", "")}
    assert [r.disk_id for r in rows] == discs(search(cat, Query("xenor", mode="discs")))
    one = D.details(cat, 1)
    assert one["disc"].first().series_name == "Pompadour Menus" and [r.title for r in one["contents"].collect()] == ["Xenor 2", "R-Kind"] and one["images"].count() == 0
    assert [tuple(r) for r in D.enabled_providers(cat.locations, {"host": "The Host"}, ["other"]).collect()] == [("host", "The Host")]
    got = {r.key: r.n for r in D.statistics(cat, spark.range(3)).collect()}
    assert got["discs"] == 7 and got["discs on amiga"] == 4 and got["titles"] == 7 and got["discs hosted"] == 2 and got["files"] == 3
    crews = spark.createDataFrame([(1, "Gang", "n", "m")], "id long, name string, notes string, members string")
    assert D.credited_crew(spark.createDataFrame([(5, 1, "Gang"), (6, 1, "Other")], "disk_id long, crew_id long, crew string"), crews).first().disk_id == 5
    media = spark.createDataFrame([(2, 1, "u", "b"), (1, 5, "u", "a"), (3, 1, "v", "c")], "id long, disk_id long, url string, source string")
    assert [tuple(r) for r in D.picture_addresses(media, cat.disks).collect()] == [("u", "a"), ("v", "c")] and D.picture_addresses(media, cat.disks, ["amiga"]).count() == 1
    assert {(r.id, r.place) for r in D.titles_in_place(cat.contents).where("disk_id = 1").collect()} == {(11, 1), (12, 2)}
