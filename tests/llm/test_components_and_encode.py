"""Groups over pairs, and encoding of whole texts."""

import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

components = pytest.importorskip("diskloom.llm.components")
encode = pytest.importorskip("diskloom.llm.encode")

FILE = Path(encode.TOKENIZERS, "byte_bpe_50k.tiktoken")


def groups(spark, pairs, **k):
    return dict(map(tuple, components.connected_groups(spark.createDataFrame(pairs, "src long, dst long"), **k).collect()))


def brute(pairs):
    label = {n: n for p in pairs for n in p}
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_chain_hub_and_random(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1001 + i) for i in range(40)]
    rnd = random.Random(3)
    noise = [(rnd.randrange(2000, 2200), rnd.randrange(2000, 2200)) for _ in range(120)]
    noise = [p for p in noise if p[0] != p[1]]
    pairs = chain + hub + noise + chain[:5] + [(b, a) for a, b in hub[:5]]
    assert groups(spark, pairs, cell_edges=20) == brute(pairs)


def test_nulls_loops_and_nothing(spark):
    assert groups(spark, [(1, None), (None, 2), (5, 5), (7, 8), (7, 7)]) == {5: 5, 7: 7, 8: 7}
    assert groups(spark, []) == {}


def verdicts(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pair_id long, left_kind string, left_id long, right_kind string, right_id long, verdict string, judged_at timestamp")
    return {(r.node_kind, r.node_id): r.group_key for r in components.verdict_groups(df.withColumn("node", F.lit("clash")).withColumn("lo", F.lit(1))).collect()}


def test_verdicts(spark):
    from datetime import datetime as D

    t1, t2 = D(2020, 1, 1), D(2021, 1, 1)
    got = verdicts(spark, [
        ("disk", 1, "image", 1, "Same ", t1), ("image", 1, "image", 2, "SAME", t1), ("image", 9, "image", 8, "same", t1),
        ("disk", 3, "disk", 4, "same", t1), ("disk", 4, "disk", 3, "different", t2),  # taken back
        ("disk", 5, "disk", 6, "unsure", t2), ("disk", 6, "disk", 5, "same", None),  # without a time: the earliest
        ("disk", 7, "disk", 7, "same", t1), ("disk", None, "disk", 7, "same", t1), ("disk", 7, "tape", 1, "same", t1), ("disk", 10, "disk", 11, "same", t1), ("disk", 10, "disk", 11, "same", t1), ("disk", 12, "disk", 13, None, t1),
    ])
    assert got == {("disk", 1): "disk:1", ("image", 1): "disk:1", ("image", 2): "disk:1", ("image", 9): "image:8", ("image", 8): "image:8", ("disk", 10): "disk:10", ("disk", 11): "disk:10"}
    assert verdicts(spark, []) == {}


@pytest.mark.skipif(not FILE.exists(), reason="no tokenizer files")
def test_encode_documents(spark):
    long = "word " * 40_000 + "é漢😀" * 5_000
    docs = spark.createDataFrame([(1, "Hello  world's\n\n end ", "x"), (2, "", "x"), (3, None, "x"), (4, long, "x"), (1, "Hello  world's\n\n end ", "x"), (5, "<|endoftext|>", "x")], "doc_id long, text string, ids string")
    rows = encode.encode_corpus(docs).collect()
    plain = encode.FragmentEncoder(str(FILE)).encoding
    assert len(rows) == 6
    for r in rows:
        text = {1: "Hello  world's\n\n end ", 4: long, 5: "<|endoftext|>"}.get(r.doc_id, "")
        assert r.ids == plain.encode_ordinary(text) and plain.decode(r.ids) == text
    assert encode.encode_corpus(docs.limit(0)).count() == 0


@pytest.mark.skipif(not FILE.exists(), reason="no tokenizer files")
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \t\n\r'sSrevmldt.,!0129aé漢😀\x1c\x85  ")), st.characters(exclude_categories=["Cs"]))))
def test_fragments_change_nothing(text):
    e = encode._encoder(str(FILE))
    assert e.encode(text) == e.encoding.encode_ordinary(text)


def test_strings_that_share_a_hash_get_different_numbers(spark):
    names = ["ab", "cd", "ef", "abc", "xyz", "lone", "longer", "", "ab"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    weak = components.string_codes(df, "name", hash_of=F.length)
    codes = dict(map(tuple, df.select("name", weak("name")).distinct().collect()))
    assert len(set(codes.values())) == len(set(names)) and codes["lone"] == 4 and codes["ab"] < 0
    strong = components.string_codes(df, "name")
    assert all(c >= 0 for (c,) in df.select(strong(F.col("name"))).collect())


def test_grid_grows_with_the_largest_degree(spark):
    hub = [(0, i) for i in range(1, 400)] + [(1000, 1001)]
    assert groups(spark, hub, cell_edges=10_000, cell_hot_edges=50) == brute(hub)
