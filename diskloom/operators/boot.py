"""What boot blocks are: known by a hash of a window, by bytes at places, by their filing CRC, or by patterns of code.

The tables of signatures, markers and rules are parameters (a few hundred rows typed by hand); they are joined like any
dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diskloom.functions.images import inspect_image


def valid_signatures(signatures: DataFrame, size: int) -> DataFrame:
    """Signatures (``ord, name, offset, length, sha1``) whose window lies within a block of ``size`` bytes and whose hash is one."""
    return signatures.where((F.col("offset") >= 0) & (F.col("length") > 0) & (F.col("offset") + F.col("length") <= size) & F.lower("sha1").rlike("^[0-9a-f]{40}$"))


def match_windows(blocks: DataFrame, signatures: DataFrame) -> DataFrame:
    """``id, name``: the first signature by ``ord`` whose window of the block (``id, boot``) has its hash.

    Only the different windows of the signatures are hashed, once for each block, and joined on (window, hash).
    """
    windows = [tuple(r) for r in signatures.select("offset", "length").distinct().orderBy("offset", "length").collect()]  # as many as there are kinds of windows
    if not windows:
        return blocks.select("id", F.lit("").alias("name")).where("false")
    hashes = F.array(*(F.struct(F.lit(o).alias("offset"), F.lit(n).alias("length"), F.sha1(F.substring("boot", o + 1, n)).alias("sha1")) for o, n in windows))
    long = blocks.where(F.col("boot").isNotNull()).select("id", F.explode(hashes).alias("w")).select("id", "w.*")
    found = long.join(signatures.select("ord", "name", F.col("offset"), "length", F.lower("sha1").alias("sha1")), ["offset", "length", "sha1"])
    return found.groupBy("id").agg(F.min(F.struct("ord", "name"))["name"].alias("name"))


def match_markers(blocks: DataFrame, markers: DataFrame) -> DataFrame:
    """``id, name``: the name of which all markers (``name, offset, bytes`` in hex) are in the block, if it is the only such name."""
    listed = [tuple(r) for r in markers.select("name", "offset", F.upper("bytes")).orderBy("name", "offset").collect()]  # typed by hand, a few hundred at most
    names = sorted({n for n, _, _ in listed})
    if not names:
        return blocks.select("id", F.lit("").alias("name")).where("false")

    def holds(name: str) -> Column:
        out = F.lit(True)
        for n, offset, data in listed:
            if n == name:
                out = out & (F.hex(F.substring("boot", offset + 1, len(data) // 2)) == data)
        return out

    held = F.filter(F.array(*(F.when(holds(n), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return blocks.where(F.col("boot").isNotNull()).select("id", held.alias("h")).where(F.size("h") == 1).select("id", F.col("h")[0].alias("name"))


def longest_prefix(rows: DataFrame, text: str, prefixes: DataFrame) -> DataFrame:
    """``rows`` with the columns of the longest ``prefix`` that the text begins with, without case, NULL if none; by its words, so no part of a word counts."""
    words = F.split(F.lower(F.trim(F.col(text))), r"[^a-z0-9]+")
    heads = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    keyed = prefixes.withColumn("_key", F.array_join(F.split(F.lower(F.trim("prefix")), r"[^a-z0-9]+"), " ")).dropDuplicates(["_key"])
    others = [c for c in prefixes.columns if c != "prefix"]
    hit = rows.select(text).distinct().select(text, F.explode(heads).alias("_key")).join(keyed, "_key")
    best = hit.groupBy(text).agg(F.max(F.struct(F.length("_key").alias("_n"), *others)).alias("_b")).select(text, *(F.col(f"_b.{c}").alias(c) for c in others))
    return rows.join(best, text, "left")


def classify(blocks: DataFrame, signatures: DataFrame, markers: DataFrame, filed: DataFrame) -> DataFrame:
    """``id, status, name, source`` of each boot block: virus, known, inactive, unknown or damaged.

    ``blocks``: id, platform, boot, boot_crc, boot_valid, boot_runs, does_nothing; ``filed``: boot_crc, name, class ('v' for
    a virus). Signatures decide first, then what is filed, then markers of blocks that run; a block that neither runs
    nor is known is inactive.
    """
    by_window = match_windows(blocks, signatures).withColumnRenamed("name", "w_name")
    by_marker = match_markers(blocks.where("boot_runs"), markers).withColumnRenamed("name", "m_name")
    known = filed.groupBy("boot_crc").agg(F.min(F.struct("name", "class")).alias("f"))
    j = blocks.join(by_window, "id", "left").join(by_marker, "id", "left").join(known, "boot_crc", "left")
    status = (
        F.when(F.col("boot").isNull(), F.struct(F.lit("damaged").alias("status"), F.lit("").alias("name"), F.lit("").alias("source")))
        .when(F.col("w_name").isNotNull(), F.struct(F.lit("virus").alias("status"), F.col("w_name").alias("name"), F.lit("signature").alias("source")))
        .when(F.col("f").isNotNull(), F.struct(F.when(F.col("f.class") == "v", "virus").otherwise("known").alias("status"), F.col("f.name").alias("name"), F.lit("filed").alias("source")))
        .when(F.col("m_name").isNotNull(), F.struct(F.lit("virus").alias("status"), F.col("m_name").alias("name"), F.lit("marker").alias("source")))
        .when(~F.col("boot_runs") | F.coalesce("does_nothing", F.lit(False)), F.struct(F.lit("inactive").alias("status"), F.lit("").alias("name"), F.lit("").alias("source")))
        .otherwise(F.struct(F.lit("unknown").alias("status"), F.lit("").alias("name"), F.lit("").alias("source")))
    )
    return j.select("id", status.alias("s")).select("id", "s.*")


def inspected_blocks(files: DataFrame) -> DataFrame:
    """Files (id, name, content) as ``classify`` takes them; images without sectors have no row."""
    rows = files.withColumn("i", inspect_image(F.col("content"), F.col("name"))).where("i.boot IS NOT NULL")
    return rows.select("id", *(F.col(f"i.{c}").alias(c) for c in ("platform", "boot", "boot_crc", "boot_valid", "boot_runs", "does_nothing")))


def same_virus(a: Column, b: Column) -> Column:
    """Whether two names of a virus are one: the words of one are the first words of the other."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != "")
    x, y = words(a), words(b)
    n = F.least(F.size(x), F.size(y))
    return (n > 0) & (F.slice(x, F.lit(1), n) == F.slice(y, F.lit(1), n))


def disc_reports(used: DataFrame, statuses: DataFrame, images: DataFrame) -> DataFrame:
    """The virus report of the dump that each disc would be written from: ``disk_id, status, name, source, alternate``.

    ``used``: disk_id, entry_id (a file of the library, or NULL), image_id (its dump, or NULL); ``statuses``: id of the
    entry and what ``classify`` says; ``images``: image_id, disk_id, name, rank, bad, virus (as the catalogue flags it).
    A checked block decides before the flag; a flag on a block that says nothing makes it flagged. Where the virus may
    not be removed, the best clean dump of the disc is named. Discs without a block to check and without a flag have
    no row.
    """
    flags = images.select("image_id", F.nullif("virus", F.lit("")).alias("flag"))
    j = used.join(statuses.select(F.col("id").alias("entry_id"), "status", "name", "source"), "entry_id", "left").join(flags, "image_id", "left")
    told = F.col("status").isin("virus", "known", "inactive")
    flagged = F.struct(F.lit("flagged").alias("status"), F.col("flag").alias("name"), F.lit("catalogue").alias("source"))
    own = F.struct("status", "name", "source")
    report = F.when(F.col("status").isNotNull() & (told | F.col("flag").isNull()), own).when(F.col("flag").isNotNull(), flagged)
    rows = j.withColumn("r", report).where("r IS NOT NULL").select("disk_id", "image_id", "r.*")
    clean = images.where("coalesce(virus, '') = '' AND NOT coalesce(bad, false)").select("disk_id", F.col("image_id").alias("_i"), F.struct("rank", F.col("image_id").alias("id"), F.col("name").alias("n")).alias("c"))
    best = rows.where("status IN ('flagged', 'virus')").select("disk_id", "image_id").join(clean, "disk_id").where(~F.col("_i").eqNullSafe(F.col("image_id"))).groupBy("disk_id").agg(F.min("c")["n"].alias("alternate"))
    return rows.join(best, "disk_id", "left").select("disk_id", "status", "name", "source", F.coalesce("alternate", F.lit("")).alias("alternate"))
