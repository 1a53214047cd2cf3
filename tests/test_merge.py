"""The ordered merge against a plain sequential version, and its rules one by one."""

import random

import pytest


from diskloom.operators.merge import RECORDS, Group, label_groups, merge_records, place_locations, resolve_crews


def rec(i, **k):
    base = dict(record_id=i, source="s", priority=10, seq=i, platform="st", kind="menu", series_key="", number=None, part="", version="", title="", attach_only=False, n_contents=1, n_media=0, images=[], locations=[])
    return base | k


def img(name="a.st", md5="", crc="", size=None):
    return (name, md5, "", "", crc, size)


def loc(url="", **k):
    return (url, k.get("member", ""), k.get("image_name", ""), "", k.get("hash_value", ""), None)


def run(spark, records):
    names = list(rec(0))
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in records], RECORDS)
    return {r.record_id: (r.disc, r.way, list(r.images)) for r in merge_records(df).collect()}


def test_rules(spark):
    got = run(spark, [
        rec(1, series_key="m", number=1, images=[img(md5="AA")]),
        rec(2, series_key="m", number=1, part="", version="v1.0", images=[img("other.st", md5="aa", crc="01", size=5)]),  # one key, one dump
        rec(3, series_key="m", number=2, images=[img(md5="bb")]),
        rec(4, images=[img(md5="aa")]),  # joins by hash
        rec(5, platform="amiga", images=[img(md5="bb")]),  # another platform: its own disc
        rec(6, series_key="m", number=3, images=[img(md5="cc")]),
        rec(7, series_key="m", number=4, images=[img(md5="cc")]),  # the hash is of two keyed discs now
        rec(8, images=[img(md5="cc")]),  # so it joins nothing
        rec(9, locations=[loc("http://x/A%20b")], title="Pack 9"),
        rec(10, locations=[loc("HTTP://x/a b ")], title="Pack 9"),
        rec(11, locations=[loc("http://x/a b")], title="Pack 8"),  # the numbers disagree
        rec(12, series_key="m", number=9, attach_only=True),
        rec(13, series_key="m", number=2, attach_only=True),
        rec(14, n_contents=0, locations=[loc("u", image_name="a.st")]),
        rec(15, images=[img("q.st"), img("Q.msa")]),  # without hashes: one name, one dump
    ])
    assert got[1] == (1, "new", [0]) and got[2] == (1, "key", [0]) and got[4] == (1, "hash", [0])
    assert got[5][:2] == (5, "new") and got[8][:2] == (8, "new") and got[7][0] == 7
    assert got[10][:2] == (9, "address") and got[11][:2] == (11, "new")
    assert got[12][:2] == (None, "dropped") and got[13][:2] == (3, "key") and got[14][:2] == (None, "later")
    assert got[15] == (15, "new", [0, 0])


def test_empty(spark):
    assert run(spark, []) == {}


@pytest.mark.parametrize("seed", range(2))
def test_groups_equal_the_whole_sequence(spark, seed):
    """Random records: groups in parallel give what one sequential pass over all records gives."""
    rnd = random.Random(seed)
    records = []
    for i in range(1, 160):
        keyed = rnd.random() < 0.4
        images = [img(f"f{rnd.randrange(9)}.st", md5=f"h{rnd.randrange(60)}" if rnd.random() < 0.8 else "") for _ in range(rnd.randrange(3))]
        urls = [loc(f"u{rnd.randrange(50)}") for _ in range(rnd.randrange(2))]
        records.append(rec(i, platform=rnd.choice(["st", "amiga"]), series_key="s" if keyed else "", number=rnd.randrange(25) if keyed else None, attach_only=keyed and rnd.random() < 0.2, title=f"T {rnd.randrange(4)}" if rnd.random() < 0.5 else "", n_contents=rnd.randrange(2), images=images, locations=urls))
    got = run(spark, records)
    plain = []
    for r in records:
        key = f"{r['series_key']}\x1f{r['number']}\x1f\x1f" if r["number"] is not None else None
        urls = [x[0] for x in r["locations"]]
        phase = (3 if r["attach_only"] else 0) if key else 1 if r["images"] else (4 if r["title"] else 5) if urls and not r["n_contents"] else 2
        plain.append(r | dict(key=key, phase=phase, urls=urls, image_keys=[[f"md5:{x[1]}"] if x[1] else [] for x in r["images"]], image_names=[[x[0], x[0][:-3]] for x in r["images"]]))
    want = {i: (d, w, list(p)) for i, d, w, p in Group({}).run([r for r in plain if r["phase"] < 5])}
    want |= {r["record_id"]: (None, "later", []) for r in plain if r["phase"] == 5}
    assert got == want


def test_labels(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7), (200, 200)]
    got = dict(map(tuple, label_groups(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert dict(map(tuple, label_groups(spark.createDataFrame(edges, "a long, b long").repartition(5), task_edges=0).collect())) == got
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100, 200: 200}
    assert label_groups(spark.createDataFrame([], "a long, b long")).count() == 0


def test_place_locations(spark):
    images = spark.createDataFrame([(1, 1, "A.st", "aa", "", "", "01", 5), (2, 2, "a.msa", "aa", "", "", "01", 6)], "image_id long, ord int, name string, md5 string, sha1 string, sha512 string, crc32 string, size long")
    locations = spark.createDataFrame([(1, "md5", "AA", None, ""), (2, "crc32", "01", 6, ""), (3, "md5", "zz", None, "A.st"), (4, "", "", None, "d/a.msa"), (5, "", "", None, "A.ipf"), (6, "", "", None, "")], "location_id long, hash_kind string, hash_value string, size long, name string")
    assert dict(map(tuple, place_locations(locations, images).collect())) == {1: 1, 2: 2, 4: 2, 5: 1}


def test_resolve_crews(spark):
    discs = spark.createDataFrame([(1, "The Gang", "st"), (2, "Duo", "st"), (3, "Twins", "st"), (4, "None", "st")], "disk_id long, crew string, platform string")
    crews = spark.createDataFrame([(10, "Gang", "a", "st", 3), (20, "Duo", "a", "st", 50), (21, "duo", "a", "st", 2), (30, "Twins", "a", "st", 5), (31, "Twins", "a", "st", 5), (32, "Twins", "b", "st", 5), (33, "Twins", "b", "st", 6)], "crew_record_id long, name string, source string, platform string, releases int")
    credits = spark.createDataFrame([(3, 31)], "disk_id long, crew_record_id long")
    pins = spark.createDataFrame([("twins", "st", "b", 33)], "key string, platform string, source string, crew_record_id long")
    got = {(r.disk_id, r.source): (r.crew_record_id, r.way) for r in resolve_crews(discs, crews, credits, pins).collect()}
    assert got == {(1, "a"): (10, "only"), (2, "a"): (20, "dominant"), (3, "a"): (31, "credited"), (3, "b"): (33, "pinned")}
