"""Builds: choice of sources, failures, publishing and installing, functions for SQL."""

import os

import pytest

from diskloom.functions import names
from diskloom.plans import build as B
from diskloom.plans.catalogue import _TABLES


def test_sources(spark):
    good = lambda v: lambda s, i: s.createDataFrame([(v,)], "v string")

    def bad(s, i):
        raise OSError("no file\nmore")

    known = [B.Source("a", good("a"), 50), B.Source("b", bad, 10), B.Source("c", good("c"), 20, registers_series=True), B.Source("d", good("d"), by_default=False)]
    assert [s.id for s in B.select_sources(known)] == ["c", "a", "b"] and [s.id for s in B.select_sources(known, only=["d"])] == ["d"]
    assert [s.id for s in B.select_sources(known, skip=["b"], extra=["d"])] == ["c", "a", "d"]
    with pytest.raises(ValueError):
        B.select_sources(known, only=["x"])
    done, failed = B.collect_all(spark, B.select_sources(known), {})
    assert [(s.id, df.first().v) for s, df in done] == [("c", "c"), ("a", "a")] and failed == {"b": "OSError: no file"}


def test_publish_and_install(tmp_path):
    snap, out = tmp_path / "snap", tmp_path / "out"
    out.mkdir()
    for t in _TABLES:
        (snap / t).mkdir(parents=True)
        (snap / t / "part").write_text(t)
    (snap / "meta.json").write_text('{"layout": 1}')
    package = str(tmp_path / "s.tar.gz")
    first = B.publish(str(snap), package)
    assert B.publish(str(snap), package) == first
    path = B.install(package, str(out))
    assert (out / "current").read_text() == os.path.basename(path) and os.path.exists(os.path.join(path, "meta.json"))
    with pytest.raises(ValueError, match="larger"):
        B.install(package, str(out), most_bytes=5)
    (tmp_path / "s.tar.gz.sha256").write_text("0  x")
    with pytest.raises(ValueError, match="hash"):
        B.install(package, str(out))
    (snap / "meta.json").write_text('{"layout": 99}')
    B.publish(str(snap), package)
    with pytest.raises(ValueError, match="layout"):
        B.install(package, str(out))
    assert (out / "current").read_text() == os.path.basename(path)


def test_small_helpers(tmp_path):
    (tmp_path / "r").write_text("1")
    one = B.fingerprint([str(tmp_path / "r"), str(tmp_path / "none")])
    (tmp_path / "r").write_text("2")
    assert one != B.fingerprint([str(tmp_path / "r"), str(tmp_path / "none")])
    assert B.newer([{"built_at": "2020"}, {"built_at": "2022"}], "2021") == {"built_at": "2022"} and B.newer([{"built_at": "2020"}], "2021") is None and B.newer([], "") is None
    steps = [lambda r: r | {"a": 1}, lambda r: r | {"b": r["a"] + 1}]
    assert B.migrate({}, steps) == {"a": 1, "b": 2, "version": 2} and B.migrate({"version": 1, "a": 5}, steps)["b"] == 6
    with pytest.raises(ValueError):
        B.migrate({"version": 3}, steps)


def test_sql_functions(spark):
    names.register(spark)
    row = spark.sql("SELECT normalise_text(c) AS n, sort_form(c) AS s, dump_name(c).title AS t FROM VALUES ('Été & Co. 9 (1990)(X)') AS v(c)").first()
    assert tuple(row) == ("ete and co 9 1990 x", "ete and co 00000009 00001990 x", "Été & Co. 9")
