"""Variant names, canonical series, surviving values."""

import random

import pytest
from pyspark.sql import functions as F

names = pytest.importorskip("diskloom.llm.names")
canon = pytest.importorskip("diskloom.llm.canon")
survivor = pytest.importorskip("diskloom.llm.survivor")
from diskloom.functions.strings import edit_distance  # noqa: E402


def pairs(spark, values, rosters=()):
    df = spark.createDataFrame([(v,) for v in values], "value string").withColumn("grp", F.lit("clash"))
    r = spark.createDataFrame(list(rosters), "value string, members array<string>") if rosters else None
    return {tuple(x) for x in names.variant_pairs(df, r).collect()}


def test_parse_crew():
    p = names.parse_crew
    assert p("The Glumfepig Guzfifep") == ("full", ["glumfepig", "guzfifep"]) and p("Gumfepig, Zorbifat")[0] == "full"
    assert p("Ab Xycodef - The Zorbifat Mulk") [0] == "joint" and p("K R A N B O T Z") == ("glued", ["kranbotz"])
    assert p("Snebt. Benro.")[0] == "cut" and p("N. Gloskulav")[0] == "initial" and p("Glmf Gzfp")[0] == "bare" and p("BOCMAGAK")[0] == "one"
    assert p("<unknown>")[0] == p("??")[0] == p(None)[0] == p("")[0] == "none"


def test_spellings_of_one_crew(spark):
    full = "Skrodipak Blumfezor"
    same = ["The Skrodipak Blumfezor", "Blumfezor, Skrodipak", "5kr0d1pak Blumf3zor", "sKRODIPAK bLUMFEZOR", "Skr&ouml;dipak Blumfezor", "SkrÃ¶dipak Blumfezor", "Skrodpak & Blumfezro", "Skrdpk Blmfzr", "Skrod. Blumf.", "Skrodipak B.", "SKRODIPAK", "S K R O D I P A K B L U M F E Z O R", "SkrodipakBlumfezor", "Ѕkrоdipаk Blumfezor"]
    other = ["Skrodipak Wintagol", "Mulborat Zinkefup", "Mulborat Zinkefup - Skrodipak Blumfezor", None, "", "n/a"]
    got = pairs(spark, [full, *same, *other[1:], full])
    values = sorted([full, *same], key=lambda s: s.encode())
    assert got == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :]}
    # a word that two crews share names neither
    assert not any("SKRODIPAK" in p for p in pairs(spark, [full, "Skrodipak Wintagol", "SKRODIPAK"]))


def test_members_tell_other_names(spark):
    rosters = [("Skrodipak Blumfezor", ["a", "b", "c", "d"]), ("Zonk Posse", ["b", "a", "c"]), ("Mulborat Zinkefup", ["a", "x", "y"]), ("Empty Crewname", []), ("Nobodyx Crewnamo", None)]
    assert pairs(spark, [r[0] for r in rosters], rosters) == {("Skrodipak Blumfezor", "Zonk Posse")}
    assert pairs(spark, []) == set()


def test_segment_join_loses_nothing(spark):
    rnd = random.Random(5)
    words = list({"".join(rnd.choice("abc") for _ in range(rnd.randrange(5, 11))) for _ in range(150)})
    df = spark.createDataFrame([(w, w) for w in words], "node string, text string")
    near = names.near_strings(df, df, 2)
    found = {frozenset((r.node, r.other)) for r in near.collect()}

    def plain(a, b):  # Levenshtein without swaps
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    want = {frozenset((a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if plain(a, b) <= 2}
    assert want <= found


def test_edit_distance_in_a_band():
    assert edit_distance("abcd", "abdc", 2) == 1 and edit_distance("abc", "abc", 0) == 0 and edit_distance("abc", "xyz", 2) == 3 and edit_distance("", "ab", 5) == 2 and edit_distance("a" * 9, "a", 2) == 3


SERIES = [("lost-kranbotz-menu", "Lost Kranbotz Menu", "amiga"), ("the-kranbotz-music", "The Lost Kranbotz Music Disks", "amiga"), ("zimfadel-pack", "Zimfadel Pack", "amiga"), ("zimfadel-pack-st", "Zimfadel Pack", "atari-st"), ("gold-mexivurt-intro-disks", "Golden Mexivurt Intro Disks", "atari-st")]
ALIASES = {
    "Lost Kranbotz menu disk 51b": "lost-kranbotz-menu", "Menu, Lost Kranbotz": "lost-kranbotz-menu", "L. Kranbotz Music Disc": "the-kranbotz-music", "lOST kRANBOTZ mUSIKDISK": "the-kranbotz-music",
    "Golden Mexvirut Intros": "gold-mexivurt-intro-disks", "the Golden Mexivurt": "gold-mexivurt-intro-disks", "G0ld3n Mex1vurt 1n7r0 Disks": "gold-mexivurt-intro-disks", "GMID": "gold-mexivurt-intro-disks",
    "Zimfadel Pack (ST)": "zimfadel-pack-st", "Zimfadel Pack": "", "Lost Kranbotz": "", "Golden Ramasut Pack": "", "Pack": "", "": "", "???": "", "Lost Kranbotz Pack": "", "Zmfdl Pck (Amiga)": "zimfadel-pack", "GoldenMexivurtIntroDisks - all discs": "gold-mexivurt-intro-disks",
}


def test_typed_series(spark):
    series = spark.createDataFrame([(*s, "x") for s in SERIES], "id string, name string, platform string, listed string")
    rows = [(i, a, None) for i, a in enumerate(ALIASES)] + [(98, None, None), (99, "Zimfadel Pack", "amiga"), (99, "Zimfadel Pack", "amiga")]
    got = dict(map(tuple, canon.map_aliases(spark.createDataFrame(rows, "alias_id long, alias string, platform string"), series).collect()))
    assert {a: got[i] for i, a in enumerate(ALIASES)} == ALIASES and got[98] == "" and got[99] == "zimfadel-pack" and len(got) == len(ALIASES) + 2
    none = canon.map_aliases(spark.createDataFrame(rows[:2], "alias_id long, alias string, platform string"), series.limit(0))
    assert [r.series_id for r in none.collect()] == ["", ""]
    assert canon.map_aliases(spark.createDataFrame([], "alias_id long, alias string, platform string"), series).count() == 0


def survivors(spark, rows, batches):
    c = spark.createDataFrame(rows, "title_id long, content_id long, publisher string, cracker string, batch_id string, rank string")
    b = spark.createDataFrame(batches, "batch_id string, priority int, retrieved timestamp")
    return {tuple(r) for r in survivor.surviving_contents(c, b).collect()}


def test_survivors(spark):
    from datetime import datetime as D

    batches = [("a", 10, D(2020, 1, 1)), ("b", 10, D(2021, 1, 1)), ("n", None, None), ("z", 95, D(2022, 1, 1))]
    rows = [
        (1, 11, "Acme Soft", "unknown", "a", ""), (1, 12, "Acm...", "Gang", "b", ""), (1, 13, "Akme", None, "n", ""), (1, 11, "Acme Soft", "unknown", "a", ""),
        (2, 21, "x", "y", "a", ""),  # one row only
        (3, 31, "??", "-", "a", ""), (3, 32, "Interac��", "n/a", "b", ""),  # nothing says anything
        (4, 41, "One", "C", "z", ""), (4, 42, "Two", "D", "n", ""), (4, 43, "Two", "D", "gone", ""),  # NULL and unknown batches count as 90
        (5, 52, "Same", "", "a", ""), (5, 51, "Same", "", "a", ""), (None, 61, "P", "Q", "a", ""), (None, 62, "P", "Q", "a", ""),
    ]
    assert survivors(spark, rows, batches) == {(1, "publisher", 11), (1, "cracker", 12), (4, "publisher", 42), (4, "cracker", 42), (5, "publisher", 51)}
    assert survivors(spark, [], batches) == set()


def test_names_of_four_words(spark):
    long = ["Zorb Kelvak Munti Dralo", "zorb kelvak muntti dralo", "ZorbKelvakMuntiDralo"]
    assert pairs(spark, long) == {(a, b) for a in long for b in long if a.encode() < b.encode()}
    crews = ["Glumfepig Guzfifep", "Skrodipak Blumfezor", "Glumfepig Guzfifep Skrodipak Blumfezor", "Glumfepig Guzfifep Skrodipak Blumfezr"]
    assert pairs(spark, crews[:3]) == set()  # two crews, by evidence


def test_short_strings_meet(spark):
    df = spark.createDataFrame([("a", "abc"), ("b", "abd"), ("c", "xyz"), ("d", "abcd"), ("e", "a")], "node string, text string")
    got = {tuple(sorted((r.node, r.other))) for r in names.near_strings(df, df, 3).collect()}
    assert {("a", "b"), ("a", "d")} <= got and ("a", "c") not in got


def test_one_roster_of_very_many_names(spark):
    words = [f"{a}{b}" for a in ("bra", "cri", "dro", "flu") for b in ("zopik", "mudev", "nigat", "xulef", "wobim")]
    values = [f"{x} {y[::-1]}" for x in words for y in words if x != y][:120]
    got = pairs(spark, values, [(v, ["m1", "m2", "m3"]) for v in values])
    assert len(got) == 120 * 119 // 2


def test_large_group_and_consensus(spark):
    rows = [(1, i, f"Name {i} Soft", "x", "a", "") for i in range(400, 0, -1)]
    assert survivors(spark, rows, [("a", 1, None)]) == {(1, "publisher", 1), (1, "cracker", 1)}
    assert survivor.consensus(["big red dog", "big red dog soft", "bigg red dog"], [1, 1, 1]) == ["big", "red", "dog"]
    assert survivor.closest(["acme soft", "acme"], ["acme"]) == 1
    rnd = random.Random(1)
    for _ in range(200):  # halving weights: the first value always wins
        values = [" ".join(rnd.choice(["ab", "cd", "ef", "abc"]) for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(1, 9))]
        assert survivor.consensus(values, [0.5**i for i in range(len(values))]) == values[0].split()


def voted(spark, rows, **parameters):
    df = spark.createDataFrame(rows, "g long, i long, v string, w double, row_id string")
    return {(r.group_id, r.row_id) for r in survivor.surviving_rows(df, ["v"], group="g", row_id="i", trust=[F.col("i")], **parameters).collect()}


def test_consensus_that_is_not_the_first_row(spark):
    rows = [(1, 1, "Brazoplik Soft", 1.0, ""), (1, 2, "Brazoplik Software", 1.0, ""), (1, 3, "Brazoplik Software", 1.0, "")]
    rows += [(2, 1, "Grunavel", 1.0, ""), (2, 2, "The Grunavel Arts", 1.0, ""), (2, 3, "Grunavel Arts", 1.0, ""), (2, 4, "Grunvel Arts", 1.0, "")]
    assert voted(spark, rows, strict=False) == {(1, 2), (2, 3)} and voted(spark, rows) == {(1, 1), (2, 1)}
    heavy = [(1, 1, "Brazoplik Soft", 5.0, ""), *rows[1:3]]
    assert voted(spark, heavy, strict=False, weight=F.col("w")) == {(1, 1)}  # the weight of a row is a parameter


def test_groups_aligned_in_chunks(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(g, i, f"Brazoplik Zorb Software {rnd.choice('abcdefgh')}{rnd.randrange(40)}" if i % 3 else "Brazoplik Zorb Software", 1.0, "") for g in (1, 2) for i in range(60)]
    whole, strict = voted(spark, rows, strict=False), voted(spark, rows)
    monkeypatch.setattr(survivor, "CHUNK", 4)
    assert voted(spark, rows, strict=False) == whole == {(1, 0), (2, 0)} and voted(spark, rows) == strict == {(1, 0), (2, 0)}


def test_strict_trust_takes_no_vote(spark):
    def plan(df):
        return df._jdf.queryExecution().toString()

    rnd = random.Random(7)
    said = ["Acme Soft", "Acme Software", "Akme Soft", "The Acme Arts", "unknown", "Acm...", "", None]
    rows = [(rnd.choice([*range(1, 60), None]), i, rnd.choice(said), rnd.choice(said), rnd.choice([1, 2, None])) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:20], "g long, i long, v string, w string, p int")
    ask = {"group": "g", "row_id": "i", "trust": [F.coalesce("p", F.lit(9))]}
    strict, loose = survivor.surviving_rows(df, ["v", "w"], **ask), survivor.surviving_rows(df, ["v", "w"], strict=False, **ask)
    assert "MapInPandas" not in plan(strict) and "MapInPandas" in plan(loose)  # the vote is taken only where it can decide
    want = set()
    for g in range(1, 60):
        mine = sorted((p or 9, i, v, w) for h, i, v, w, p in rows if h == g) if sum(r[0] == g for r in rows) > 1 else []
        for f, k in (("v", 2), ("w", 3)):
            want |= {(g, f, r[1]) for r in [r for r in mine if r[k] in said[:4]][:1]}
    got = [tuple(r) for r in strict.collect()]
    assert set(got) == want and len(got) == len(want) and {tuple(r) for r in loose.collect()} != want
    with pytest.raises(ValueError):
        survivor.surviving_rows(df, ["v"], weight=F.lit(2.0), **ask)
