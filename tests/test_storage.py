"""Small files through Spark's file systems, long values of dumps, bounds of archives, shared folders."""

import io
import time
import zipfile

import pytest

from diskloom.session import ensure_checkpoint_dir
from diskloom.sources import dumps
from diskloom.sources.files import expand_archives
from diskloom.sources.filesystem import Store


def test_store(spark, tmp_path):
    folder = f"file:{tmp_path}"
    store = Store(folder, spark)
    store.write_text(f"{folder}/a.part", "näme\n")
    store.rename(f"{folder}/a.part", f"{folder}/a")
    store.write_text(f"{folder}/b.part", "two")
    store.rename(f"{folder}/b.part", f"{folder}/a")  # takes the place of the old file
    assert store.read_text(f"{folder}/a") == "two" and not store.exists(f"{folder}/b.part") and store.is_folder(folder)
    ((name, size, stamp),) = [s for s in store.stamp(folder) if not s[0].rsplit("/", 1)[-1].startswith(".")]
    assert name.endswith("/a") and size == 3 and stamp > 0
    with pytest.raises(OSError):
        store.rename(f"{folder}/missing", f"{folder}/c")


def test_long_values_of_dumps(spark, tmp_path):
    lines = ["CREATE TABLE `t` (\n", "  `a` int,\n", "  `b` text\n", ");\n", "INSERT INTO `t` VALUES (1,'first\n", *(f"line {i}; it''s \\' quoted\n" for i in range(40_000)), "last'),(2,'x');\n"]
    began = time.perf_counter()
    rows = list(dumps.dump_rows(lines, "t"))
    assert time.perf_counter() - began < 20  # each line is looked at once
    assert [r["a"] for r in rows] == [1, 2] and rows[0]["b"].startswith("first\nline 0; it's ' quoted\n") and rows[0]["b"].endswith("last")
    path = tmp_path / "d.sql"
    path.write_text("CREATE TABLE `t` (\n  `a` int,\n  `b` text\n);\nINSERT INTO `t` VALUES (1,'x;\ny'),(2,NULL);\n")
    dumps.register(spark)
    read = lambda **o: spark.read.format("sqldump").options(table="t", **o).load(str(path))
    assert sorted(map(tuple, read().collect())) == [(1, "x;\ny"), (2, None)]
    assert read(columns="a").columns == ["a"] and sorted(r.a for r in read(columns="a").collect()) == [1, 2]
    with pytest.raises(Exception, match="no column z"):
        read(columns="z").collect()


def test_bounds_of_archives_are_parameters(spark):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.st", b"d" * 10)
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a.st", b"a" * 100)
        z.writestr("in.zip", inner.getvalue())
    files = spark.createDataFrame([("p.zip", bytearray(outer.getvalue()))], "path string, content binary")
    small = {r.member: r.error for r in expand_archives(files, most_bytes=99).collect()}
    assert small["a.st"] == "larger than is read"
    assert {r.member for r in expand_archives(files).collect()} == {"a.st", "in.zip::deep.st"}
    assert {r.member for r in expand_archives(files, most_nested=0).collect()} == {"a.st", "in.zip"}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
