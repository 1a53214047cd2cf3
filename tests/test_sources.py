"""Readers of dumps, DATs, listings and archives, on invented inputs."""

import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from diskloom.functions.dumpnames import dump_name, parse_dump_name, tidy_label, trailing_brackets
from diskloom.sources import dats, dumps, files, listings


def rows(df):
    return [tuple(r) for r in df.collect()]


SQL = """-- a comment; with a sign
CREATE TABLE `games` (
  `id` int(11) NOT NULL,
  `name` varchar(255),
  `score` double,
  PRIMARY KEY (`id`)
);
INSERT INTO `news` VALUES (1,'a; b (c'),(2,'it''s
two lines');
INSERT INTO `games` VALUES (1,'It\\'s; a ''test''
over lines',1.5),(2,NULL,-2),(3,_binary 'x%y\\%',NULL);
INSERT INTO `games` (`name`,`id`) VALUES ('late',4) ON DUPLICATE KEY UPDATE name='x';
INSERT INTO `games` VALUES (5,0x4869,0);
"""


@pytest.mark.parametrize("packed", [False, True])
def test_sql_dump(spark, tmp_path, packed):
    path = tmp_path / "dump.bin"
    path.write_bytes(gzip.compress(SQL.encode()) if packed else SQL.encode())
    dumps.register(spark)
    df = spark.read.format("sqldump").option("table", "games").option("rename", "name=title").load(str(path))
    assert df.dtypes == [("id", "bigint"), ("title", "string"), ("score", "double")]
    assert sorted(rows(df), key=lambda r: r[0]) == [(1, "It's; a 'test'\nover lines", 1.5), (2, None, -2.0), (3, "x%y\\%", None), (4, "late", None), (5, "Hi", 0.0)]


def test_sql_dump_errors():
    with pytest.raises(dumps.DumpError):
        list(dumps.insert_rows("(1,2)", 3, "t"))
    with pytest.raises(dumps.DumpError):
        list(dumps.dump_rows(["INSERT INTO `t` VALUES (1);\n"], "t"))
    assert list(dumps.dump_rows([], "t")) == []


def test_copy_dump(spark, tmp_path):
    path = tmp_path / "x.sql"
    path.write_text("COPY public.other (id) FROM stdin;\n1\n\\.\nCOPY public.nick (id, name) FROM stdin;\n7\tA\\tB\\\\\n8\t\\N\n9\t\\x41\\101\\q\n\\.\nSELECT 1;\n")
    dumps.register(spark)
    assert rows(spark.read.format("pgcopy").option("table", "nick").load(str(path))) == [("7", "A\tB\\"), ("8", None), ("9", "AAq")]


XML = """﻿<?xml version="1.0"?><datafile><header><name>X</name></header>
<game name="Zork II (1990)(Acme)(Disk 1 of 2)[cr Crew][a2]"><rom name="Zork II.st" size="737280" crc="ABCDEF01" md5="AA" sha1="BB"/></game>
<game name="Pack 7 (1991)(Crew)"><rom name="Pack 7.msa" size="5" crc="00000001"/><rom name="b.msa" size="6" crc="00000002"/></game></datafile>"""
OLD = 'clrmamepro (\n\tname "X"\n)\n\ngame (\n\tname "Old (1989)(-)"\n\trom ( name "Old.st" size 12 crc 0A0B0C0D md5 ff )\n)\n'


def test_dats(spark, tmp_path):
    (tmp_path / "Atari ST - Games - [ST] (TOSEC-v2025-01-15_CM).dat").write_text(XML)
    (tmp_path / "old.dat").write_text(OLD)
    with zipfile.ZipFile(tmp_path / "pack.zip", "w") as z:
        z.writestr("TOSEC/In (TOSEC-v1_CM).dat", XML)
        z.writestr("Other/no.dat", XML)
    got = dats.dat_pack(spark, str(tmp_path))
    assert got.count() == 3 + 1 + 3
    assert rows(got.where("dat = 'old'").drop("dat", "dat_version")) == [("Old (1989)(-)", "Old.st", 12, "0a0b0c0d", "ff", "")]
    assert {r.dat_version for r in got.collect()} == {"2025-01-15", "", "1"}
    (tmp_path / "plain.xml").write_text(XML.lstrip("﻿"))
    assert sorted(r.crc32 for r in dats.xml_dat(spark, str(tmp_path / "plain.xml")).collect()) == ["00000001", "00000002", "abcdef01"]
    named = dats.named_roms(got.where("dat_version = '1'"))
    assert {(r.parsed.title, r.parsed.cracker, r.flags) for r in named.collect()} == {("Zork II", "Crew", "[cr Crew][a2]"), ("Pack 7", "", "")}


def test_series_discovery(spark):
    data = [(f"Mega Pack {i}", "Crew") for i in (1, 2)] + [(f"Rush {i}", "Crew") for i in (1, 2, 3)] + [(f"Rise #{i}", "X") for i in (1, 2)] + [("Alone 1", "X")]
    got = dats.discover_series(spark.createDataFrame(data, "title string, publisher string"), "title", "publisher")
    assert {(r.series_base, r.number) for r in got.collect()} == {("Mega Pack", 1), ("Mega Pack", 2), ("Rise", 1), ("Rise", 2)}


def test_collapse_alternates(spark):
    data = [("A (1990)(X)[a]", "a1"), ("A (1990)(X)", "a0"), ("A (1990)(X)[b]", "ab"), ("A (1990)(X)[cr C]", "c")]
    roms = spark.createDataFrame([(g, n, 1, "", "", "") for g, n in data], "game string, name string, size long, crc32 string, md5 string, sha1 string")
    got = {(r.release, r.cracker): (r.game, [d.name for d in r.dumps]) for r in dats.collapse_alternates(dats.named_roms(roms)).collect()}
    assert got == {("A (1990)(X)", ""): ("A (1990)(X)", ["a0", "a1", "ab"]), ("A (1990)(X)", "C"): ("A (1990)(X)[cr C]", ["c"])}


def test_dump_names(spark):
    p = parse_dump_name("Engine, The v1.2 (1990-06-xx)(Acme (UK))(de)(Part A)[cr X][t +2 Band][h Y][a2][b virus damage].adf")
    want = dict(title="Engine, The", version="v1.2", date="1990-06-xx", publisher="Acme (UK)", extra=["de", "Part A"], cracker="X", trainer="t +2 Band", trainer_group="Band", trainer_count="+2", modified_by="Y", alternate=2, bad=True, virus_damage=True, extension="adf", part="A", media="Part A")
    assert {k: p[k] for k in want} == want
    assert trailing_brackets("(only)") == ("(only)", []) and parse_dump_name("")["title"] == "" and parse_dump_name(None) is None
    two = parse_dump_name("A (1990)(X)[cr Y] & B (1991)(Z)[cr W].st")
    assert (two["title"], two["publisher"], two["cracker"], two["combined"], two["date"]) == ("A & B", "X - Z", "Y - W", True, "1990")
    assert parse_dump_name("T (1990)(-)(Disk 2 of 3)[v Gremlin][m Protector]")["virus"] == "Gremlin"
    df = spark.createDataFrame([("Engine, The (1990)(A)(Disk 1 of 2)[cr X][a].st",), (None,)], "n string")
    got = df.select(dump_name(F.col("n")).alias("p"), tidy_label(F.col("n")).alias("l")).collect()
    assert got[0].p.disk == 1 and got[0].l == "The Engine (Disk 1 of 2) [cr X]" and got[1].p.title is None


def test_index_and_texts(spark, tmp_path):
    (tmp_path / "i.txt").write_text("CRC\tSize\tFile name\n----\nABCDEF01\t12\tPacks/Big_Fish/BIG-Pack12[b].dms\nxx\t1\ty\n0a0b0c0d\t3\tPacks/x.txt\n")
    index = listings.file_index(spark, str(tmp_path / "i.txt"))
    assert sorted(rows(index)) == [("0a0b0c0d", 3, "Packs/x.txt"), ("abcdef01", 12, "Packs/Big_Fish/BIG-Pack12[b].dms")]
    assert rows(listings.pack_files(index, "Packs/", (".dms",)).select("folder", "stem", "suffix", "flags")) == [("Big_Fish", "BIG-Pack12", ".dms", "[b]")]
    one = lambda f, v: spark.createDataFrame([(v,)], "v " + ("binary" if isinstance(v, bytes) else "string")).select(f(F.col("v")).alias("x")).first().x
    assert one(listings.split_words, "BigFish130b_X") == "Big Fish 130 b X"
    assert one(listings.clean_scroller, b"\r\n\x1b[31mH\xe9llo \r\n\x07 you\r\n\r\n") == "Héllo\n you"
    assert one(listings.plain_text, "[b]Hi[/b] **you** &amp; [url=x]me[/url]<br>[docs](http://x)") == "Hi you & me\ndocs"
    assert one(listings.article_title, "https://en.wikipedia.org/wiki/Nick_%28x%29?y") == "Nick (x)"


def test_html_tables(spark):
    page = "<table><tr><td>[M]<td><td>2024<td></tr><tr><td><a href='//h/a%20b.zip'>M/a b.zip</a><td><td>2024-01-01<td id=size>12</tr></table>"
    df = spark.createDataFrame([("p", page)], "path string, text string")
    assert rows(listings.archive_listing(df)) == [("p", "M/a b.zip", "https://h/a%20b.zip", "2024-01-01", 12)]
    games = "<table>" + "".join(f"<tr>{''.join(f'<td>{c}</td>' for c in r)}</tr>" for r in [("Zork", "1MB", "", "AU 12", "game"), ("", "", "", "PP3", ""), ("Yak", "", "", "AU12", "doc"), ("x", "y")]) + "</table>"
    got = {r.disk: [tuple(t) for t in r.titles] for r in listings.reverse_index(spark.createDataFrame([("p", games)], "path string, text string")).collect()}
    assert got == {"AU12": [("Zork", "game", "1MB"), ("Yak", "doc", "")], "PP3": [("Zork", "game", "")]}
    entries = listings.list_entries(spark.createDataFrame([("p", 'x<a href="q/a_01.st">A</a><li> One &amp; 1</li><li>Two</li><a href="q/a_02.st">B</a><li>Three</li>')], "path string, text string"), r'<a href="[^"]*/(a_\d+\.st)">')
    assert sorted(rows(entries)) == [("p", "A_01.ST", 0, "One & 1"), ("p", "A_01.ST", 1, "Two"), ("p", "A_02.ST", 0, "Three")]


def test_text_lists(spark, tmp_path):
    text = " \tFIRST DISKS\n\nCD1\tALPHA\n\tBETA\nCD2\tGAMMA\n\tSECOND DISKS\nCD1\tDELTA\n"
    assert sorted(rows(listings.crew_lists(spark.createDataFrame([("p", text)], "path string, text string")).drop("path"))) == [("FIRST DISKS", "CD1", 0, "ALPHA"), ("FIRST DISKS", "CD1", 1, "BETA"), ("FIRST DISKS", "CD2", 0, "GAMMA"), ("SECOND DISKS", "CD1", 0, "DELTA")]
    assert listings.crew_lists(spark.createDataFrame([("p", text), ("q", None)], "path string, text string")).count() == 4
    (tmp_path / "c.txt").write_text("ACE\t\t\tPompadour Crappy #1\nnothing\n")
    assert rows(listings.title_index(spark, str(tmp_path / "c.txt"))) == [("ACE", "Pompadour Crappy", "1")]
    (tmp_path / "d.txt").write_text("Program Name      Type      Disk\n1st. Shapes     Docs   12\n")
    assert rows(listings.document_list(spark, str(tmp_path / "d.txt"))) == [("1st. Shapes", "Docs", "12")]
    parts = spark.createDataFrame([(1, "", 0), (2, "", 1), (2, "B", 2), (3, "2", 3), (3, "4A", 4), (4, "C", 5)], "n int, part string, o int")
    got = {(r.n, r.part): (r.final_part, r.final_version) for r in listings.assign_parts(parts, ["n"], "part", "o").collect()}
    assert got == {(1, ""): ("", ""), (2, ""): ("", "v1"), (2, "B"): ("", "v2"), (3, "2"): ("A", ""), (3, "4A"): ("B", ""), (4, "C"): ("C", "")}


def test_json_and_toml(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"results": {"bindings": [{"item": {"value": "Q1"}, "label": {"value": "Nick"}, "article": {"value": "u"}}, {"item": {"value": "Q2"}, "label": {"value": "Two"}, "article": {"value": "v"}}, {"item": {"value": "Q3"}, "label": {"value": "two"}, "article": {"value": "w"}}]}}')
    assert rows(listings.unique_articles(listings.sparql_rows(spark, str(tmp_path / "a.json")))) == [("nick", "Q1", "u")]
    (tmp_path / "t.json").write_text('{"tree": [{"path": "d", "type": "tree", "sha": "0"}, {"path": "d/f", "type": "blob", "sha": "1"}]}')
    assert rows(listings.git_tree(spark, str(tmp_path / "t.json"))) == [("d/f", "1")]
    (tmp_path / "f.json").write_text('{"files": [{"name": "a.zip", "size": "7", "md5": "AB", "format": "ZIP"}]}')
    assert rows(listings.item_files(spark, str(tmp_path / "f.json"))) == [("a.zip", None, 7, "ab", "", "", "ZIP")]
    (tmp_path / "s1.json").write_text('{"items": [{"identifier": "b", "title": "Menu 1"}, {"identifier": "a", "title": "x"}]}')
    assert rows(listings.found_items(spark, str(tmp_path / "s*.json"), "^Menu")) == [("b", "Menu 1")]
    (tmp_path / "r.toml").write_text('[[series]]\nid = "a"\nnames = ["x", "y"]\n[[series]]\nid = "b"\n')
    assert rows(listings.toml_entries(spark, str(tmp_path / "r.toml"), "series", {"id": "string", "names": "array<string>"})) == [(0, "a", ["x", "y"]), (1, "b", None)]
    names = spark.createDataFrame([("2024-01-02.sql",), ("2025-01-01.sql.gz",), ("x",)], "n string")
    assert listings.latest_dump(names, "n").first().n == "2025-01-01.sql.gz"


def test_files_and_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.st", b"deep")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.st", b"abc")
        z.writestr("../evil.st", b"no")
        z.writestr("in.zip", inner.getvalue())
    (tmp_path / "b.adz").write_bytes(gzip.compress(b"xyz"))
    (tmp_path / "c.st").write_bytes(b"c")
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "l.lha").write_bytes(b"xx-lh5-xx")
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "h.st").write_bytes(b"h")
    found = files.expand_archives(files.scan(spark, str(tmp_path)))
    got = {(r.path.rsplit("/", 1)[-1], r.member): (None if r.content is None else bytes(r.content), bool(r.error)) for r in found.collect()}
    assert got[("a.zip", "d/x.st")] == (b"abc", False) and got[("a.zip", "in.zip::deep.st")] == (b"deep", False) and got[("b.adz", "b.adf")] == (b"xyz", False)
    assert got[("c.st", "")] == (b"c", False) and got[("bad.zip", "")][1] and got[("l.lha", "")][1] and len(got) == 6
    hashed = files.with_hashes(spark.createDataFrame([(b"abc",), (b"",)], "content binary")).orderBy("size_bytes").collect()
    assert (hashed[1].crc32, hashed[1].md5, hashed[0].crc32) == ("352441c2", "900150983cd24fb0d6963f7d28e17f72", "00000000")
    keys = spark.createDataFrame([("A", "", "", "0B", 5), ("", "", "", "1", None)], "m string, s string, h string, c string, n long").select(files.hash_keys(*(F.col(c) for c in "mshcn")).alias("k")).collect()
    assert [r.k for r in keys] == [["md5:a", "crc:0b:5"], []]
    pick = spark.createDataFrame([(1, "d/Game.st"), (1, "a.st"), (2, "readme.txt"), (2, "b.adf"), (3, "x.txt")], "k int, m string")
    assert sorted(rows(files.choose_member(pick, "k", "m", F.lit("game.msa")))) == [(1, "d/Game.st"), (2, "b.adf")]
