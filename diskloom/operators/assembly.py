"""Putting the rows of merged discs together: dumps filled from each other, pictures, notes and crews placed and made distinct."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diskloom.functions import names as N
from diskloom.operators.relational import first_present, joined_distinct, ranked_in
from diskloom.operators.skew import lookup_join


def filled_dumps(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], flags: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each dump: each field from the first row that has it, each flag if any row has it."""
    values = first_present(rows, keys, fields, order)
    return values.join(rows.groupBy(*keys).agg(*(F.bool_or(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags)), list(keys))


def crew_rows(records: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each crew from its records: notes joined, members pooled, the first founding date that is given."""
    base = first_present(records, keys, ["founded"], order)
    notes = joined_distinct(records, keys, "notes", order, "\n\n")
    pooled = records.select(*keys, F.struct(*order).alias("_o"), F.posexplode("members").alias("_p", "_m")).where(F.trim("_m") != "")
    pooled = pooled.groupBy(*keys, F.trim("_m").alias("_m")).agg(F.min(F.struct("_o", "_p")).alias("_at")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_m"))), lambda x: x["_m"]).alias("members"))
    out = base.join(notes, list(keys), "left").join(pooled, list(keys), "left")
    return out.withColumn("notes", F.coalesce("notes", F.lit(""))).withColumn("members", F.coalesce("members", F.array().cast("array<string>")))


def location_images(locations: DataFrame, images: DataFrame) -> DataFrame:
    """``location_id, image_id``: the first dump of the location's own disc that it names by any hash, else by file name."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    values = images.select("disk_id", "image_id", "ord", F.explode(F.concat(F.array_distinct(F.transform(F.array(*(F.col(h) for h in ("md5", "sha1", "sha512", "crc32"))), lambda h: F.concat(F.lit("#"), low(h)))), F.transform(N.image_name_keys(F.coalesce("name", F.lit(""))), lambda n: F.concat(F.lit("/"), n)))).alias("k"))
    wants = locations.select("disk_id", "location_id", F.explode(F.concat(F.array(F.concat(F.lit("#"), low("hash_value"))), F.transform(N.image_name_keys(F.coalesce("image_name", F.lit(""))), lambda n: F.concat(F.lit("/"), n)))).alias("k")).where("k NOT IN ('#', '/')")
    return wants.join(values.where("k NOT IN ('#', '/')"), ["disk_id", "k"]).groupBy("location_id").agg(F.min(F.struct("ord", "image_id"))["image_id"].alias("image_id"))


def title_targets(wanted: DataFrame, contents: DataFrame) -> DataFrame:
    """Every title that an item (``item_id, platform, title``) stands for: ``item_id, disk_id, content_id``; a single's only title also gives the disc itself.

    ``contents``: disk_id, content_id, platform, title, single. Titles meet by any of their keys on the platform.
    """
    keyed = lambda df: df.withColumn("k", F.explode(N.title_keys(F.col("title"))))
    hits = keyed(wanted).select("item_id", "platform", "k").join(keyed(contents).select("platform", "k", "disk_id", "content_id", "single"), ["platform", "k"]).select("item_id", "disk_id", "content_id", "single").distinct()
    return hits.select("item_id", "disk_id", "content_id").unionByName(hits.where("single").select("item_id", "disk_id", F.lit(None).cast("long").alias("content_id"))).distinct()


def distinct_notes(notes: DataFrame, contents: DataFrame, disks: DataFrame) -> DataFrame:
    """Notes and articles of discs, each once: an article goes to the first game that has it, else to the first title; a note that the disc's own notes say is dropped.

    ``notes``: id, disk_id, content_id, kind (note or article), text; ``contents``: content_id, kind; ``disks``: disk_id, notes.
    """
    rows = notes.where(F.trim("text") != "").withColumn("text", F.trim("text"))
    rows = rows.groupBy("disk_id", "content_id", "kind", "text").agg(F.min("id").alias("id"))
    own = disks.select("disk_id", F.explode(F.split(F.coalesce("notes", F.lit("")), "\n")).alias("n")).select("disk_id", N.normalise(F.col("n")).alias("_k")).where("_k <> ''").distinct()
    plain = rows.where("kind <> 'article'").withColumn("_k", N.normalise(F.col("text"))).join(own, ["disk_id", "_k"], "left_anti").drop("_k")
    game = contents.select("content_id", (F.col("kind") == "game").alias("_g"))
    articles = rows.where("kind = 'article'").join(game, "content_id", "left").withColumn("_k", N.normalise(F.col("text")))
    best = articles.groupBy("disk_id", "_k").agg(F.min(F.struct(~F.coalesce("_g", F.lit(False)), "id", "content_id")).alias("b"), F.min(F.struct("id", "text")).alias("t"))
    kept = best.select("disk_id", F.col("b.content_id").alias("content_id"), F.lit("article").alias("kind"), F.col("t.text").alias("text"), F.col("t.id").alias("id"))
    return plain.unionByName(kept)


def distinct_media(media: DataFrame, order: Sequence[str]) -> DataFrame:
    """Pictures of each disc and title once for each address, the first in ``order``."""
    return ranked_in(media, ["disk_id", "content_id", "url"], order, "_k").where("_k = 1").drop("_k")


def distinct_locations(locations: DataFrame) -> DataFrame:
    """Download locations of each disc once for each address and member, the lowest priority."""
    return ranked_in(locations.withColumn("_u", N.url_key(F.col("url"))), ["disk_id", "_u", "member"], ["priority", "location_id"], "_k").where("_k = 1").drop("_k", "_u")


def disc_crew(series_group: Column, series_name: Column, cracker: Column, publisher: Column, in_series: Column) -> Column:
    """The crew of a disc: of its series (group or name), else who cracked it, else who published it, else "Unknown crew"."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(F.when(in_series, F.coalesce(some(series_group), some(series_name))).otherwise(F.coalesce(some(cracker), some(publisher))), F.lit("Unknown crew"))


def disc_label(template: Column, series_name: Column, number: Column, part: Column, version: Column, tidy: Column) -> Column:
    """The label of a disc: its series' template where it is numbered, else the tidied name with the part that it lacks, else "Untitled disk"."""
    plain = F.when((part != "") & ~F.upper(tidy).contains(F.upper(part)), F.concat_ws(" ", F.nullif(tidy, F.lit("")), part)).otherwise(tidy)
    return F.coalesce(F.when(number.isNotNull() & (series_name != ""), N.format_label(template, series_name, number, part, version)), F.nullif(plain, F.lit("")), F.lit("Untitled disk"))


def expand_groups(name: Column, groups: DataFrame, rows: DataFrame, platform: str) -> DataFrame:
    """``rows`` with ``expanded``: each crew of a list "A - B" replaced by the full name that its tag stands for on the platform, else anywhere.

    ``groups``: tag, platform ('' for any), full. Tags compare by crew key.
    """
    listed = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_n", name)
    pieces = listed.select("_id", platform, F.posexplode(F.split("_n", " - ")).alias("_p", "_c")).withColumn("_k", N.crew_key(F.col("_c")))
    known = groups.groupBy(N.crew_key(F.col("tag")).alias("_k"), F.col("platform").alias("_pl")).agg(F.min("full").alias("full"))
    j = pieces.join(known, "_k", "left").where(F.col("_pl").isNull() | (F.col("_pl") == "") | (F.col("_pl") == F.col(platform)))
    best = j.groupBy("_id", "_p", "_c").agg(F.min_by("full", F.when(F.col("_pl") == F.col(platform), 0).otherwise(1)).alias("full"))
    best = pieces.select("_id", "_p", "_c").join(best.select("_id", "_p", "full"), ["_id", "_p"], "left")
    out = best.groupBy("_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("full", "_c").alias("v")))), lambda x: x["v"])), " - ").alias("expanded"))
    return listed.join(out, "_id", "left").drop("_id", "_n")


def ranked_sources(local: DataFrame, online: DataFrame) -> DataFrame:
    """Where to take each disc from, best first: own files before downloads, good dumps before bad, then dump rank and priority: ``disk_id, place, kind, ref``."""
    a = local.select("disk_id", F.lit(0).alias("c"), F.lit("file").alias("kind"), F.col("path").alias("ref"), F.coalesce("bad", F.lit(False)).alias("bad"), F.coalesce("rank", F.lit(2**31 - 1)).alias("rank"), F.lit(0).alias("priority"))
    b = online.select("disk_id", F.lit(1).alias("c"), F.lit("download").alias("kind"), F.col("url").alias("ref"), F.coalesce("bad", F.lit(False)).alias("bad"), F.coalesce("rank", F.lit(2**31 - 1)).alias("rank"), "priority")
    return ranked_in(a.unionByName(b), ["disk_id"], ["bad", "c", "rank", "priority", "ref"], "place").select("disk_id", "place", "kind", "ref")


def pictures_by_dump(pictures: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """``name, media`` of each dated dump name: its pictures in the order of their kinds.

    ``pictures``: name, kind, url. Names without a date ("(1990)...") stand for no dump.
    """
    dated = pictures.where(F.col("name").rlike(r"\([12][0-9xX]{3}(-[0-9xX]{2}){0,2}\)"))
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    return dated.groupBy("name").agg(F.transform(F.array_sort(F.collect_set(F.struct(place.alias("p"), "url", "kind"))), lambda x: F.struct(x["kind"].alias("kind"), x["url"].alias("url"))).alias("media"))


def picture_counts(addresses: DataFrame, cached: DataFrame) -> DataFrame:
    """How many different pictures each source has, how many of them are in the cache with their bytes, and how many are left: ``source, host, cached, bytes, left``.

    ``addresses``: url, source; ``cached``: url, bytes.
    """
    rows = addresses.groupBy("url").agg(F.min("source").alias("source")).withColumn("host", N.host_of(F.col("url")))
    j = rows.join(cached.groupBy("url").agg(F.max("bytes").alias("bytes")), "url", "left")
    return j.groupBy("source", "host").agg(F.count("bytes").alias("cached"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(F.col("bytes").isNull()).alias("left"))


def disc_folders(discs: DataFrame, categories: DataFrame, names: dict[str, str], kinds: dict[str, str], default: str) -> DataFrame:
    """``disk_id, platform_folder, type_folder, crew_folder`` under which a disc is filed.

    ``discs``: id, platform, kind, in_series, group_name, series_name, cracker, publisher, as the user corrected them;
    ``categories``: disk_id, category of discs that list titles (``relational.majority``). A disc without titles goes
    by its kind (``kinds``), else to ``default``.
    """
    pick = lambda table, c: F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)
    j = discs.join(categories.withColumnRenamed("disk_id", "id"), "id", "left")
    crew = disc_crew(F.col("group_name"), F.col("series_name"), F.col("cracker"), F.col("publisher"), F.col("in_series"))
    folder = F.coalesce(pick(names, F.col("platform")), F.col("platform"), F.lit("Unknown platform"))
    return j.select(F.col("id").alias("disk_id"), folder.alias("platform_folder"), F.coalesce("category", pick(kinds, F.col("kind")), F.lit(default)).alias("type_folder"), crew.alias("crew_folder"))


def location_hashes(locations: DataFrame, images: DataFrame) -> DataFrame:
    """Locations (location_id, image_id, hash_kind, hash_value) whose hash is blanked where their dump has the same one."""
    own = images.select("image_id", F.explode(F.array(*(F.struct(F.lit(k).alias("hash_kind"), F.lower(k).alias("_own")) for k in ("md5", "sha1", "sha512", "crc32")))).alias("x")).select("image_id", "x.*")
    j = locations.join(own, ["image_id", "hash_kind"], "left")
    return j.withColumn("hash_value", F.when(F.lower("hash_value") == F.col("_own"), "").otherwise(F.col("hash_value"))).drop("_own")


def merge_totals(merged: DataFrame, records: DataFrame) -> DataFrame:
    """What became of the records of each source (``merged`` of ``merge.merge_records``): ``source, way, n``; attach-only records that no disc took count as dropped."""
    return lookup_join(merged.select("record_id", "way"), records.select("record_id", "source").distinct(), "record_id", "inner").groupBy("source", "way").agg(F.count(F.lit(1)).alias("n"))


def unplaced(items: DataFrame, placed: DataFrame, item_id: str = "item_id") -> DataFrame:
    """How many items of each source found no place: ``source, n, unplaced``."""
    hit = placed.select(item_id).distinct().withColumn("_hit", F.lit(True))
    return items.join(hit, item_id, "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_hit").isNull()).alias("unplaced"))


def new_series(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Series that records name and no list declares, to be registered: ``id, platform, n`` records of each."""
    return rows.where("series_key <> ''").groupBy(F.col("series_key").alias("id")).agg(F.min("platform").alias("platform"), F.count(F.lit(1)).alias("n")).join(listed.select("id"), "id", "left_anti")
