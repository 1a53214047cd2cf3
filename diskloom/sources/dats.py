"""DAT files: lists of known dumps, as XML or in the older text form, alone, in folders or in zip packs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.functions.dumpnames import dump_name

#: An explicit schema: inference makes a game with one rom a struct and one with several an array.
XML_SCHEMA = "_name string, rom array<struct<_name string, _size bigint, _crc string, _md5 string, _sha1 string>>"
_ROWS = "dat string, dat_version string, game string, name string, size bigint, crc32 string, md5 string, sha1 string"
_GAME = re.compile(r'^game \(\s*\n\s*name "((?:[^"\\]|\\.)*)"(.*?)^\)', re.M | re.S)
_ROM = re.compile(r'rom \( name "((?:[^"\\]|\\.)*)" (.*?)\)\s*$', re.M)


def xml_dat(spark: SparkSession, path: str) -> DataFrame:
    """Games of XML DATs at ``path``, one row for each rom: splittable, read by the built-in XML source."""
    games = spark.read.format("xml").option("rowTag", "game").schema(XML_SCHEMA).load(path)
    rows = games.select(F.col("_name").alias("game"), F.explode("rom").alias("r"))
    return rows.select("game", F.col("r._name").alias("name"), F.col("r._size").alias("size"), *(F.lower(F.coalesce(f"r._{h}", F.lit(""))).alias(n) for h, n in (("crc", "crc32"), ("md5", "md5"), ("sha1", "sha1"))))


def dat_games(data: bytes) -> Iterator[tuple[str, list[dict[str, str]]]]:
    """(name, roms) of every game of one DAT, of either form, with or without a byte order mark."""
    body = data.removeprefix(b"\xef\xbb\xbf")
    if not body.lstrip().startswith(b"clrmamepro"):
        for _, element in ElementTree.iterparse(io.BytesIO(body)):
            if element.tag == "game":
                yield element.get("name", ""), [dict(r.attrib) for r in element.iter("rom")]
                element.clear()
        return
    for game, inside in _GAME.findall(body.decode("utf-8", "replace")):
        roms = [dict(re.findall(r"(\w+) (\S+)", fields)) | {"name": name.replace('\\"', '"')} for name, fields in _ROM.findall(inside)]
        yield game.replace('\\"', '"'), roms


def _members(path: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """The DATs in a file: itself, or those under TOSEC/ of a zip pack."""
    if not zipfile.is_zipfile(io.BytesIO(data)):
        yield path, data
        return
    with zipfile.ZipFile(io.BytesIO(data)) as pack:
        for name in pack.namelist():
            if name.startswith("TOSEC/") and name.endswith(".dat"):
                yield name, pack.read(name)


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, data in zip(b["path"], b["content"]):
            rows = []
            for name, body in _members(path, data):
                m = re.fullmatch(r"(.+?) \(TOSEC-v([^)]+?)(?:_CM)?\)\.dat", name.rsplit("/", 1)[-1])
                dat, version = (m[1], m[2]) if m else (name.rsplit("/", 1)[-1].removesuffix(".dat"), "")
                for game, roms in dat_games(body):
                    for r in roms:
                        size = r.get("size", "")
                        rows.append((dat, version, game, r.get("name", ""), int(size) if size.isdigit() else None, *(r.get(h, "").lower() for h in ("crc", "md5", "sha1"))))
            yield pd.DataFrame(rows, columns=["dat", "dat_version", "game", "name", "size", "crc32", "md5", "sha1"]).astype({"size": "Int64"})


def dat_pack(spark: SparkSession, path: str) -> DataFrame:
    """Roms of all DATs at ``path``: DAT files of both forms and zip packs of them, with the DAT's name and version."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(_expand, _ROWS)


def named_roms(roms: DataFrame) -> DataFrame:
    """Roms with the facts of their game's name: ``parsed``, and the dump's flags written out."""
    out = roms.withColumn("parsed", dump_name(F.col("game")))
    return out.withColumn("flags", F.array_join(F.transform("parsed.flags", lambda f: F.concat(F.lit("["), f, F.lit("]"))), "")).withColumn("format", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))


#: Numbers that make a numbered name a series: so many where they are marked as disc numbers, so many elsewhere.
MARKED_NUMBERS, PLAIN_NUMBERS = 2, 4
# Words in front of a number that mark it as a disc's.
MARKER_WORDS = ("compact", "compacts", "compil", "compilation", "disc", "disk", "disks", "issue", "menu", "pack", "packs", "vol", "volume")


def numbered_names(rows: DataFrame, title: str) -> DataFrame:
    """Titles that end in a number, with ``base``, ``number`` and whether it is ``marked`` as a disc's number."""
    from diskloom.functions.names import display_title, normalise, words_of

    pattern = r"^(.*?\S)\s*(?i:(#|no\.?|nr\.?|vol\.?|volume|issue)\s*)?0*(\d+)$"
    shown = display_title(F.col(title))
    base = F.trim(F.regexp_extract(shown, pattern, 1))
    out = rows.withColumn("base", base).withColumn("number", F.regexp_extract(shown, pattern, 3).try_cast("int"))
    last = F.try_element_at(words_of(normalise(F.col("base"))), F.lit(-1))
    return out.where(F.col("number").isNotNull()).withColumn("marked", (F.regexp_extract(shown, pattern, 2) != "") | F.coalesce(last.isin(*MARKER_WORDS), F.lit(False)))


def discover_series(rows: DataFrame, title: str, publisher: str) -> DataFrame:
    """``rows`` with ``series_base`` of the numbered series found among their titles, NULL where there is none.

    A series is a name of one publisher under enough different numbers. Counting is one aggregation by name, joined
    back.
    """
    from diskloom.functions.names import normalise

    numbered = numbered_names(rows, title).withColumn("_n", normalise(F.col("base"))).withColumn("_p", normalise(F.col(publisher)))
    found = numbered.groupBy("_n", "_p").agg(F.countDistinct("number").alias("n"), F.bool_or("marked").alias("m"), F.min("base").alias("series_base"))
    found = found.where(F.col("n") >= F.when(F.col("m"), MARKED_NUMBERS).otherwise(PLAIN_NUMBERS)).select("_n", "_p", "series_base")
    return numbered.join(found, ["_n", "_p"]).drop("_n", "_p")


def collapse_alternates(roms: DataFrame) -> DataFrame:
    """Dumps of one release (the name without its flags, by cracker) as one row: the best dump's name and all dumps, best first."""
    from diskloom.functions.names import image_rank_key

    stem = F.trim(F.regexp_replace("game", r"\s*\[[^\]]*\]", ""))
    rows = roms.withColumn("_s", stem).withColumn("_r", image_rank_key(F.col("parsed.flags")))
    dumps = F.array_sort(F.collect_list(F.struct("_r", "name", "size", "crc32", "md5", "sha1")))
    return rows.groupBy("_s", F.col("parsed.cracker").alias("cracker")).agg(F.min_by("game", F.struct("_r", "game")).alias("game"), dumps.alias("dumps")).withColumnRenamed("_s", "release")
