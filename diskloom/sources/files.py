"""Files of a collection: a recursive scan, the members of archives, and their hashes."""

from __future__ import annotations

import gzip
import io
import os
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What files are looked at, by suffix.
IMAGE_SUFFIXES = ("adf", "adz", "dim", "dms", "gz", "img", "ipf", "msa", "raw", "scp", "st", "stx", "hfe")
ARCHIVE_SUFFIXES = ("zip", "7z", "lha", "lzh")
#: Unpacked bytes of one member, and archives within archives, that are read if not told otherwise.
MOST_BYTES, MOST_NESTED = 64 << 20, 1


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES + ARCHIVE_SUFFIXES, content: bool = True) -> DataFrame:
    """Files under a folder with a wanted suffix: ``path, size, mtime`` and, if asked for, ``content``.

    Hidden folders and files are passed over, and empty files, which the file source does not list. Without ``content`` only the listing is read.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace(F.try_url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    rows = rows.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes) & ~F.col("path").rlike(r"/\.[^/]"))
    out = rows.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if content else []))
    return out


def archive_kind(head: Column, name: Column) -> Column:
    """What packs a file, by its first bytes and else by its suffix: zip, gz, 7z, lzh or ''."""
    starts = lambda h: F.hex(F.substring(head, 1, 8)).startswith(h)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(starts("504B0304") | starts("504B0506"), "zip").when(starts("1F8B"), "gz").when(starts("377ABCAF271C"), "7z").when(F.hex(F.substring(head, 3, 3)) == "2D6C68", "lzh").when(suffix.isin("zip", "7z"), suffix).when(suffix.isin("gz", "adz"), "gz").when(suffix.isin("lha", "lzh"), "lzh").otherwise("")


def safe_name(stored: str) -> str:
    """A member's name as a path below the archive, '' if it leaves it or names a folder."""
    parts = [p for p in stored.replace("\\", "/").split("/") if p not in ("", ".")]
    if stored.endswith(("/", "\\")) or ".." in parts or (parts and ":" in parts[0]):
        return ""
    return "/".join(parts)


def _kind(data: bytes, name: str) -> str:
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    if data[:2] == b"\x1f\x8b":
        return "gz"
    if data[:6] == b"7z\xbc\xaf\x27\x1c":
        return "7z"
    return "lzh" if data[2:5] == b"-lh" else ""


def members(name: str, data: bytes, depth: int = 0, *, most_bytes: int = MOST_BYTES, most_nested: int = MOST_NESTED) -> Iterator[tuple[str, bytes | None, str]]:
    """(member, bytes, error) of an archive; members of an archive inside it are named "outer::inner".

    A member of more than ``most_bytes``, damaged, or packed in a way that needs a tool of its own gives an error in
    place of bytes, and the others go on; archives are opened ``most_nested`` deep. The bounds keep a small file that
    unpacks without end from filling a task; raise them where such files are known to be sound.
    """
    kind = _kind(data, name)
    if kind == "gz":
        base = os.path.basename(name)
        inner = base[:-3] if base.lower().endswith(".gz") else base[:-4] + ".adf" if base.lower().endswith(".adz") else base
        try:
            with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
                body = f.read(most_bytes + 1)
            yield (inner, None, "larger than is read") if len(body) > most_bytes else (inner, body, "")
        except (OSError, EOFError, zlib.error) as e:
            yield inner, None, str(e)
        return
    if kind != "zip":
        yield "", None, f"{kind or 'unknown'} archives need a tool that is not here"
        return
    try:
        pack = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        yield "", None, str(e)
        return
    for info in pack.infolist():
        member = safe_name(info.filename)
        if not member:
            continue
        if info.file_size > most_bytes:
            yield member, None, "larger than is read"
            continue
        try:
            body = pack.read(info)
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, zlib.error, OSError) as e:
            yield member, None, str(e)
            continue
        if depth < most_nested and _kind(body, member) == "zip":
            for inner, found, error in members(member, body, depth + 1, most_bytes=most_bytes, most_nested=most_nested):
                yield f"{member}::{inner}", found, error
        else:
            yield member, body, ""


def _expand(most_bytes: int, most_nested: int):
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["path"], b["content"]):
                if _kind(data, path):
                    rows = [(path, m, body, error) for m, body, error in members(path, data, most_bytes=most_bytes, most_nested=most_nested)]
                else:
                    rows = [(path, "", data, "")]
                yield pd.DataFrame(rows, columns=["path", "member", "content", "error"])

    return expand


def expand_archives(files: DataFrame, *, most_bytes: int = MOST_BYTES, most_nested: int = MOST_NESTED) -> DataFrame:
    """Every image in files (``path, content``): the file itself or the members of an archive, ``path, member, content, error`` (see ``members``)."""
    return files.select("path", "content").mapInPandas(_expand(most_bytes, most_nested), "path string, member string, content binary, error string")


def with_hashes(rows: DataFrame, content: str = "content") -> DataFrame:
    """``rows`` with the size and the four hashes of a binary column, in lower case; all built in."""
    c = F.col(content)
    return rows.withColumns({"size_bytes": F.length(c).cast("long"), "crc32": F.lpad(F.lower(F.hex(F.crc32(c))), 8, "0"), "md5": F.md5(c), "sha1": F.sha1(c), "sha512": F.sha2(c, 512)})


def hash_keys(md5: Column, sha1: Column, sha512: Column, crc32: Column, size: Column) -> Column:
    """The keys by which dumps are one: each hash, and the CRC with the size, as an array of texts in lower case."""
    whole = [F.when(h != "", F.concat(F.lit(f"{n}:"), F.lower(h))) for n, h in (("md5", md5), ("sha1", sha1), ("sha512", sha512))]
    return F.array_compact(F.array(*whole, F.when((crc32 != "") & size.isNotNull(), F.concat(F.lit("crc:"), F.lower(crc32), F.lit(":"), size.cast("string")))))


def choose_member(rows: DataFrame, key: str, member: str, wanted: Column, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """The member of each download to take: the wanted name, else one of the same stem, else the first image by name."""
    base = F.lower(F.regexp_extract(member, r"([^/:]*)$", 1))
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    want = F.lower(F.regexp_extract(wanted, r"([^/:]*)$", 1))
    image = F.regexp_extract(base, r"\.([^.]+)$", 1).isin(*suffixes)
    rank = F.when((want != "") & (base == want), 0).when((want != "") & (stem(base) == stem(want)), 1).when(image, 2)
    return rows.withColumn("_r", rank).where("_r IS NOT NULL").groupBy(key).agg(F.min(F.struct("_r", member))[member].alias(member))
