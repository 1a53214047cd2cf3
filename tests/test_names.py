"""Comparison, sort and search forms of names."""

import pytest
from pyspark.sql import functions as F

from diskloom.functions import names as N


def ask(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", function(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


CASES = {
    "normalise": [("Zak's & Bob_2", "zaks and bob 2"), ("ÉTOILE  Noire", "etoile noire"), ("Straße", "strasse"), ("", ""), ("--", ""), (None, None), ("X-Ray", "x ray")],
    "search_text": [("X-Ray II", "x ray ii xray"), ("plain", "plain"), ("A/B c", "a b c ab")],
    "title_search_text": [("Turbo II", "turbo ii 2 turboii"), ("Speed 2", "speed 2 ii speed2"), ("1 2", "1 2 ii"), ("One", "one"), ("Big Red Dog", "big red dog bigred reddog")],
    "display_title": [("Engine, The", "The Engine"), ("Engine, The - Demo", "The Engine - Demo"), ("Engine, A Long", "Engine, A Long"), ("Engine, The Long", "The Engine Long"), ("Engine", "Engine"), ("Nuit, La (1990)", "La Nuit (1990)")],
    "title_key": [("Engine, The (Europe)", "the engine"), ("Nick v1.1 [cr XY]", "nick"), ("A _ B", "a and b")],
    "sort_key": [("Disk 9", "disk 00000009"), ("Disk 123456789", "disk 123456789"), ("a1b22", "a00000001b00000022")],
    "sort_title": [("The Engine", "engine"), ("Engine, The", "engine"), ("B-Oh", "b oh"), ("The", "the"), ("An Apple 3", "apple 00000003")],
    "normalise_part": [("Disk 1 of 2", "A"), ("1", "A"), ("a", "A"), ("", ""), ("27", "27"), ("Boot", "BOOT"), ("side 2", "B")],
    "normalise_version": [("Version 2", "v2"), ("V2.0", "v2"), ("bis", "v2"), ("1", ""), ("v1.0", ""), ("beta", "beta"), ("03.50", "v3.5"), ("", "")],
    "slug": [("Q-Zap Menu", "q-zap-menu"), ("Été!", "ete")],
    "crew_key": [("The Harbour Boys", "harbour boys"), ("Red & Blue Inc.", "red and blue inc"), ("The Gnork's", "gnorks")],
    "distinct_words": [("a b a  c b", "a b c")],
    "url_key": [("HTTP://X.org/A%20B ", "http://x.org/a b"), ("a+b", "a+b"), ("50%", "50%")],
    "host_of": [("https://Me@Host.org:80/x", "host.org"), ("nothing", "")],
    "suffix_of": [("dir/Game.ADF", "adf"), ("none", "")],
    "sanitise_name": [("a/b:c?.adf", "b_c_.adf"), ("...", "download")],
}


@pytest.mark.parametrize("name", CASES)
def test_text_functions(spark, name):
    given = [v for v, _ in CASES[name]]
    assert ask(spark, getattr(N, name), given) == [w for _, w in CASES[name]]


def test_arrays(spark):
    assert ask(spark, N.tokens, ["a250", "250b x", "ab12c"]) == [["a", "250"], ["250", "b", "x"], ["ab", "12", "c"]]
    assert ask(spark, N.title_words, ["The Quest of X II", "The"]) == [["quest", "x", "2"], ["the"]]
    assert ask(spark, N.title_keys, ["Engine, The (Demo)"]) == [["the engine", "the engine demo", "engine the demo"]]
    assert ask(spark, N.image_name_keys, ["d/A.St", "plain"]) == [["a.st", "a"], ["plain"]]
    assert ask(spark, N.akas, ["[doc] aka Foo; Bar", "none"]) == [["Foo", "Bar"], []]
    assert ask(spark, N.split_combined, ["A (1990)(X)[cr Y] & B (1991)(Z)", "C & D"]) == [["A (1990)(X)[cr Y]", "B (1991)(Z)"], ["C & D"]]


def test_dates(spark):
    got = [tuple(r) for r in ask(spark, N.parse_date, ["1989", "1989-06", "1989-06-17", "1989-xx-xx", "19xx", "1889", "1989-13-01", "19890", ""])]
    assert got == [(1989, None, None), (1989, 6, None), (1989, 6, 17), (1989, None, None)] + [(None, None, None)] * 2 + [(1989, None, None)] + [(None, None, None)] * 2
    strict = ask(spark, N.strict_date, ["1990", "1990-06", "1990-02-30", "x", "1990-06-30"])
    assert [None if r is None else tuple(r) for r in strict] == [(1990, None, None), (1990, 6, None), None, None, (1990, 6, 30)]
    assert ask(spark, lambda c: N.date_text(N.parse_date(c)), ["1990", "1990-06", "1990-06-03", ""]) == ["1990", "1990-06", "1990-06-03", ""]
    assert ask(spark, lambda c: N.date_words(N.parse_date(c)), ["1990", "1990-06-03"]) == ["1990", "1990 06"]


def test_image_rank(spark):
    got = ask(spark, lambda c: N.image_rank_key(N.dump_flags(c)), ["", "[!]", "[a2]", "[b]", "[t +2]", "[a][h X]"])
    assert [tuple(r) for r in got] == [(0, 0, 1), (0, 0, 0), (0, 2, 1), (2, 0, 1), (1, 0, 1), (1, 1, 1)]


def test_label(spark):
    rows = spark.createDataFrame([("{name} {number3}{part_suffix}{version_suffix}", "Menu", 7, "B", ""), ("{name} {number}", "Menu", None, "", "")], "t string, n string, k int, p string, v string")
    got = rows.select(N.format_label(F.col("t"), F.col("n"), F.col("k"), F.col("p"), F.col("v")).alias("x")).collect()
    assert [r.x for r in got] == ["Menu 007 B", "Menu"]
