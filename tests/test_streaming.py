"""The stream of new files reads each file once, also over restarts."""

from diskloom.streaming.new_files import index_new_files, new_files


def test_each_file_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        q = index_new_files(new_files(spark, str(folder), "*.st"), out, state)
        q.awaitTermination(120)
        return sorted(r.display_name for r in spark.read.parquet(out).collect())

    (folder / "one.st").write_bytes(bytes(737_280))
    assert run() == ["one"]
    (folder / "two.st").write_bytes(b"x")
    (folder / "note.txt").write_bytes(b"x")
    assert run() == ["one", "two"] and run() == ["one", "two"]
