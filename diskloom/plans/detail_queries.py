"""Queries of the operators that put a disc's details together, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.operators import assembly as A
from diskloom.operators import library as L
from diskloom.operators import menus as M
from diskloom.operators import relational as R
from diskloom.plans import detail as D
from diskloom.plans import sqltext as T
from diskloom.session import table

Q = {}
SQL = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


@query("""
    WITH m AS (SELECT DISTINCT id, disk_id, image_id, path, display_name, size_bytes FROM library_files WHERE disk_id IS NOT NULL AND path IS NOT NULL)
    SELECT disk_id, url, id, credit FROM (SELECT disk_id, path AS url, id, 'Found as ' || path || ' {x}' AS credit, row_number() OVER (PARTITION BY disk_id, path ORDER BY size_bytes NULLS FIRST, image_id IS NOT NULL, id) AS k FROM m) WHERE k = 1""")
def media_written_out(spark: SparkSession, d: str) -> DataFrame:
    """Addresses kept as shared beginnings and rests, joined back with their credit lines; each of a disc once."""
    files = table(spark, d, "library_files").where("disk_id IS NOT NULL AND path IS NOT NULL").select("id", "disk_id", "image_id", "path", "size_bytes").distinct()
    parts = files.select("path").distinct().select("path", F.regexp_extract("path", "^(.*/)[^/]*$", 1).alias("head"))
    prefixes = parts.select(F.col("head").alias("text")).distinct().withColumn("id", F.xxhash64("text"))
    rows = files.join(parts, "path").select(
        "id", "disk_id", F.col("image_id").alias("content_id"), F.lit("file").alias("kind"), F.col("size_bytes").alias("rank"), F.xxhash64("head").alias("url_prefix"), F.expr("substring(path, length(head) + 1)").alias("url_rest"),
        F.xxhash64("head").alias("page_prefix"), F.expr("substring(path, length(head) + 1)").alias("page_rest"), F.lit(None).cast("long").alias("thumb_prefix"), F.lit(None).cast("string").alias("thumb_rest"), F.lit(1).cast("long").alias("credit_id"),
    )
    credits = spark.createDataFrame([(1, "library", "Found as {page} {{x}}")], "id long, source string, credit string")
    return D.media_rows(rows, prefixes, credits).select("disk_id", "url", "id", "credit")


@query("""
    WITH t AS (SELECT DISTINCT doc_id AS id, disk_id, CASE WHEN lang IS NULL THEN NULL ELSE disk_id END AS content_id, source FROM documents WHERE disk_id IS NOT NULL)
    SELECT id, disk_id, row_number() OVER (PARTITION BY disk_id ORDER BY content_id IS NOT NULL, number NULLS FIRST, id) AS place, CASE WHEN source = 'web' THEN source ELSE '' END AS title
    FROM t LEFT JOIN (SELECT id AS content_id, number FROM disks) c USING (content_id)""")
def trivia_of_discs(spark: SparkSession, d: str) -> DataFrame:
    """Texts about each disc in their order: about the disc first, then about its titles."""
    rows = table(spark, d, "documents").where("disk_id IS NOT NULL").select(F.col("doc_id").alias("id"), "disk_id", F.when(F.col("lang").isNotNull(), F.col("disk_id")).alias("content_id"), F.when(F.col("source") == "web", "wikipedia").otherwise("note").alias("kind"), F.col("source").alias("text")).distinct()
    contents = table(spark, d, "disks").select("id", F.col("number").alias("position"))
    return D.trivia_rows(rows, contents).select("id", "disk_id", F.col("place").cast("long"), "title")


_ENTRIES = "(SELECT DISTINCT id, disk_id, coalesce(display_name, '') AS display_name, path, coalesce(member_path, '') AS member FROM library_files)"


@query(f"""
    WITH e AS (SELECT *, {T.words(T.search_text('display_name'))} AS a, {T.words(T.search_text('member'))} AS b FROM {_ENTRIES}),
    l AS (SELECT *, len(a) + len(b) AS len, len(list_filter(a, lambda t: starts_with(t, 'quest'))) + len(list_filter(b, lambda t: starts_with(t, 'quest'))) AS f FROM e),
    g AS (SELECT count(*) AS n_rows, count(*) FILTER (f > 0) AS n, sum(len) / count(*) AS mean FROM l)
    SELECT id, round(-(CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_rows - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS rank
    FROM l, g WHERE f > 0 AND disk_id IS NULL ORDER BY round(-(CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_rows - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))), 9), display_name, id LIMIT 50""")
def unmatched_files_found(spark: SparkSession, d: str) -> DataFrame:
    """Files without a disc whose names hold the beginning of a word, best first."""
    rows = table(spark, d, "library_files").select("id", "disk_id", F.coalesce("display_name", F.lit("")).alias("display_name"), "path", F.coalesce("member_path", F.lit("")).alias("member")).distinct()
    return L.search_unmatched(rows.select("*", F.lit("").alias("label"), F.col("member").alias("listing")), "Quest", 50).select("id", F.round("rank", 6).alias("rank"))


@query("""
    SELECT count(*) AS images, count(disk_id) AS matched, count(*) - count(disk_id) AS unmatched, count(k) - count(DISTINCT k) AS copies, count(DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1)) AS folders
    FROM (SELECT DISTINCT id, disk_id, path, CASE WHEN raw_crc32 <> '' THEN raw_crc32 ELSE md5 END AS k FROM library_files)""")
def library_in_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Images, matched and unmatched ones, copies and folders of the library."""
    return L.library_counts(table(spark, d, "library_files").select("id", "disk_id", "path", F.col("raw_crc32").alias("raw_md5"), "md5").distinct())


@query("SELECT path, max(size_bytes) AS size, max(last_seen) AS mtime, coalesce(max(nullif(error, '')), '') AS error FROM library_files GROUP BY path")
def files_scanned(spark: SparkSession, d: str) -> DataFrame:
    """What a scan knows of each file."""
    return L.scanned_files(table(spark, d, "library_files").select("path", F.col("size_bytes").alias("size"), F.col("last_seen").alias("mtime"), "error"))


@query("""
    WITH e AS (SELECT DISTINCT path, coalesce(member_path, '') AS member, lower(md5) AS s, image_id FROM library_files),
    o AS (SELECT path, min(member) AS member, min(s) AS s FROM e GROUP BY path HAVING count(*) = 1 AND count(image_id) = 0 AND min(s) <> ''),
    w AS (SELECT path, min(id) AS disk FROM library_files GROUP BY path),
    k AS (SELECT DISTINCT path, '' AS member, 'old' AS s, 1 AS disk FROM library_files WHERE size_bytes = 737280)
    SELECT o.path, o.member, o.s AS sha1, w.disk AS kept_disk FROM o JOIN w USING (path)
    UNION ALL SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = k.path AND o.member = k.member)""")
def files_linked(spark: SparkSession, d: str) -> DataFrame:
    """Every file linked to a disc: only those with one image that matches no dump take the link, other links stay."""
    files = table(spark, d, "library_files")
    entries = files.select("path", F.coalesce("member_path", F.lit("")).alias("member"), F.lower("md5").alias("sha1"), F.lit("").alias("raw_sha1"), "image_id").distinct()
    wanted = files.groupBy("path").agg(F.min("id").alias("disk_id")).withColumn("source", F.lit("user"))
    kept = files.where("size_bytes = 737280").select("path", F.lit("").alias("member"), F.lit("old").alias("sha1"), F.lit(1).cast("long").alias("kept_disk"), F.lit("").alias("source")).distinct()
    return L.link_files(kept, entries, wanted).select("path", "member", "sha1", "kept_disk")


@query("""
    WITH a AS (SELECT name AS url, min(source) AS source FROM images GROUP BY name), c AS (SELECT replace(display_name, ' ', '_') || '.st' AS url, max(size_bytes) AS bytes FROM library_files WHERE display_name IS NOT NULL AND size_bytes IS NOT NULL GROUP BY 1)
    SELECT source, count(bytes) AS cached, coalesce(sum(bytes), 0)::BIGINT AS bytes, count(*) - count(bytes) AS left_over FROM a LEFT JOIN c USING (url) GROUP BY source""")
def pictures_by_source(spark: SparkSession, d: str) -> DataFrame:
    """How many pictures each source has, are cached with their bytes, and are left."""
    cached = table(spark, d, "library_files").where("display_name IS NOT NULL AND size_bytes IS NOT NULL").select(F.concat(F.replace("display_name", F.lit(" "), F.lit("_")), F.lit(".st")).alias("url"), F.col("size_bytes").alias("bytes"))
    return A.picture_counts(table(spark, d, "images").select(F.col("name").alias("url"), "source"), cached).select("source", "cached", "bytes", F.col("left").alias("left_over"))


@query("""
    WITH c AS (
      SELECT disk_id, category FROM (SELECT *, row_number() OVER (PARTITION BY disk_id ORDER BY t, n DESC, list_position(['Games', 'Applications', 'Demos', 'Music'], category)) AS k FROM (
        SELECT r.record_id AS disk_id, CASE WHEN c.kind IN ('game', 'tool', 'demo') THEN 0 ELSE 1 END AS t, CASE c.kind WHEN 'game' THEN 'Games' WHEN 'tool' THEN 'Applications' WHEN 'demo' THEN 'Demos' WHEN 'doc' THEN 'Games' END AS category, count(*) AS n
        FROM (SELECT DISTINCT record_id FROM disk_records) r JOIN (SELECT DISTINCT * FROM content_records) c USING (record_id) WHERE c.kind IN ('game', 'tool', 'demo', 'doc') GROUP BY ALL)) WHERE k = 1),
    r AS (SELECT record_id, min(platform) AS platform, min(kind) AS kind, min(series_key) AS series_key, min(cracker) AS cracker, min(publisher) AS publisher FROM disk_records GROUP BY record_id)
    SELECT record_id AS disk_id, CASE platform WHEN 'amiga' THEN 'Amiga' WHEN 'atari-st' THEN 'Atari ST' ELSE coalesce(platform, 'Unknown platform') END AS platform_folder, coalesce(c.category, CASE kind WHEN 'pack' THEN 'Demos' END, 'Games') AS type_folder,
           coalesce(CASE WHEN series_key <> '' THEN coalesce(nullif(s.group_name, ''), nullif(s.name, '')) ELSE coalesce(nullif(cracker, ''), nullif(publisher, '')) END, 'Unknown crew') AS crew_folder
    FROM r LEFT JOIN c ON c.disk_id = r.record_id LEFT JOIN series_defs s ON s.id = r.series_key""".replace("LEFT JOIN series_defs s", "LEFT JOIN (SELECT id, name, group_name FROM series_defs) s"))
def folders_of_discs(spark: SparkSession, d: str) -> DataFrame:
    """The folders under which each record's disc is filed."""
    contents = table(spark, d, "content_records").dropDuplicates()
    categories = R.majority(contents, ["record_id"], "kind", {"game": "Games", "tool": "Applications", "demo": "Demos"}, {"doc": "Games"}, ["Games", "Applications", "Demos", "Music"]).withColumnRenamed("record_id", "disk_id")
    series = table(spark, d, "series_defs").select(F.col("id").alias("series_key"), F.col("name").alias("series_name"), "group_name")
    discs = table(spark, d, "disk_records").groupBy(F.col("record_id").alias("id")).agg(*(F.min(c).alias(c) for c in ("platform", "kind", "series_key", "cracker", "publisher"))).join(series, "series_key", "left").withColumn("in_series", F.col("series_key") != "")
    return A.disc_folders(discs, categories, {"amiga": "Amiga", "atari-st": "Atari ST"}, {"pack": "Demos"}, "Games")


@query("""
    WITH l AS (SELECT DISTINCT id, image_id, md5 FROM library_files)
    SELECT l.id, CASE WHEN lower(l.md5) = lower(i.md5) THEN '' ELSE l.md5 END AS hash_value FROM l LEFT JOIN (SELECT id AS image_id, md5 FROM images) i USING (image_id)""")
def hashes_kept_of_locations(spark: SparkSession, d: str) -> DataFrame:
    """The hash of each location, blank where its dump has the same one."""
    locations = table(spark, d, "library_files").select(F.col("id").alias("location_id"), "image_id", F.lit("md5").alias("hash_kind"), F.col("md5").alias("hash_value")).distinct()
    none = F.lit("")
    images = table(spark, d, "images").select(F.col("id").alias("image_id"), "md5", none.alias("sha1"), none.alias("sha512"), "crc32")
    return A.location_hashes(locations, images).select(F.col("location_id").alias("id"), "hash_value")


@query("SELECT series_key AS id, min(platform) AS platform, count(*) AS n FROM disk_records WHERE series_key <> '' AND series_key NOT IN (SELECT id FROM series_defs WHERE platform = 'amiga') GROUP BY series_key")
def series_to_register(spark: SparkSession, d: str) -> DataFrame:
    """Series that records name and a list does not declare."""
    return A.new_series(table(spark, d, "disk_records"), table(spark, d, "series_defs").where("platform = 'amiga'"))


@query("SELECT source, count(*) AS n, count(*) FILTER (i.id IS NULL) AS unplaced FROM (SELECT DISTINCT record_id AS id, source FROM disk_records) r LEFT JOIN (SELECT DISTINCT record_id AS id FROM image_records WHERE crc32 <> '') i USING (id) GROUP BY source")
def records_without_dumps(spark: SparkSession, d: str) -> DataFrame:
    """How many records of each source have no dump with a checksum."""
    items = table(spark, d, "disk_records").select(F.col("record_id").alias("item_id"), "source").distinct()
    return A.unplaced(items, table(spark, d, "image_records").where("crc32 <> ''").select(F.col("record_id").alias("item_id")))


@query("""
    WITH p AS (SELECT DISTINCT coalesce(d.title, '') || ' (1990)(X)' AS name, i.format AS kind, i.name AS url FROM images i JOIN (SELECT id AS disk_id, title FROM disks) d USING (disk_id))
    SELECT name, string_agg(kind || ':' || url, ' ' ORDER BY list_position(['st', 'msa', 'adf', 'stx', 'dms'], kind), url, kind) AS media FROM p GROUP BY name""")
def pictures_of_dump_names(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of each dated dump name in the order of their kinds."""
    titles = table(spark, d, "disks").select(F.col("id").alias("disk_id"), "title")
    rows = table(spark, d, "images").join(titles, "disk_id").select(F.concat(F.coalesce("title", F.lit("")), F.lit(" (1990)(X)")).alias("name"), F.col("format").alias("kind"), F.col("name").alias("url"))
    out = A.pictures_by_dump(rows, ["st", "msa", "adf", "stx", "dms"])
    return out.select("name", F.array_join(F.transform("media", lambda m: F.concat(m["kind"], F.lit(":"), m["url"])), " ").alias("media"))


@query("""
    WITH n AS (SELECT DISTINCT record_id, content_id, pos, title FROM content_records WHERE title IS NOT NULL),
    t AS (SELECT record_id, string_agg(title, '|' ORDER BY pos NULLS FIRST, content_id, title) AS titles FROM n GROUP BY record_id),
    d AS (SELECT record_id, arg_min(batch_id, record_id) AS set_id, min(part) AS part, min(notes) AS notes, min(number) AS number FROM disk_records GROUP BY record_id)
    SELECT d.record_id AS disk_id, b.name || CASE WHEN number IS NULL THEN '' ELSE ' ' || number::VARCHAR END AS label, trim(coalesce(notes, '')) AS notes, t.titles
    FROM d JOIN (SELECT batch_id AS set_id, name FROM source_batches) b USING (set_id) LEFT JOIN t USING (record_id)""")
def menu_disc_records(spark: SparkSession, d: str) -> DataFrame:
    """Records joined from sets, menus, discs, titles and dumps; conditions, people and crews are empty here, as no table holds them."""
    rows = table(spark, d, "disk_records").groupBy("record_id").agg(F.min_by("batch_id", "record_id").alias("batch_id"), F.min("part").alias("part"), F.min("notes").alias("notes"), F.min("number").alias("number"))
    sets = table(spark, d, "source_batches").select(F.col("batch_id").alias("id"), "name")
    menus = rows.select(F.col("record_id").alias("id"), F.col("batch_id").alias("set_id"), "number", F.lit(None).cast("string").alias("issue"), F.lit(None).cast("string").alias("version"))
    none = F.lit(None).cast("long")
    discs = rows.select(F.col("record_id").alias("id"), F.col("record_id").alias("menu_id"), "part", none.alias("condition_id"), none.alias("donor_id"), "notes")
    empty = spark.createDataFrame([], "id long, name string")
    contents = table(spark, d, "content_records").where("title IS NOT NULL").select(F.col("record_id").alias("disk_id"), F.col("content_id").alias("id"), F.col("pos").alias("position"), "title", "kind", F.lit("").alias("other")).distinct()
    dumps = table(spark, d, "image_records").select(F.col("record_id").alias("disk_id"), F.col("image_record_id").alias("id"), "name", F.lit("").alias("sha512"), F.col("size_bytes").alias("size")).distinct()
    crews = spark.createDataFrame([], "set_id string, name string, position int")
    out = M.menu_discs(sets, menus, discs, empty, empty, crews, contents, dumps).join(sets.withColumnRenamed("id", "set_id"), "set_id")
    label = F.concat_ws(" ", "name", F.col("number").cast("string"))
    return out.select("disk_id", label.alias("label"), F.coalesce("notes", F.lit("")).alias("notes"), F.nullif(F.array_join(F.transform("contents", lambda c: c["title"]), "|"), F.lit("")).alias("titles"))


QUERIES = Q
