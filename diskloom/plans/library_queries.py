"""Queries of the library and assembly operators over the catalogue's tables and its files, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.operators import assembly as A
from diskloom.operators import library as L
from diskloom.plans import detail
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


# Keeping a library in step


@query("""
    WITH k AS (SELECT path, arg_min(size_bytes, (last_seen, id)) AS size, min(last_seen) AS mtime, arg_min(error, (last_seen, id)) AS error FROM library_files WHERE path < '/scan' OR path >= '/scan/c' GROUP BY path),
    f AS (SELECT path, arg_max(size_bytes, (last_seen, id)) AS size, max(last_seen) AS mtime FROM library_files WHERE path < '/vault/dumps/u' GROUP BY path)
    SELECT coalesce(k.path, f.path) AS path, CASE WHEN f.path IS NULL THEN CASE WHEN starts_with(k.path, '/vault/tosec/') THEN 'keep' ELSE 'remove' END
      WHEN k.path IS NOT NULL AND k.size IS NOT DISTINCT FROM f.size AND k.mtime IS NOT DISTINCT FROM f.mtime AND coalesce(k.error, '') = '' THEN 'skip' ELSE 'read' END AS action
    FROM k FULL JOIN f ON k.path = f.path""")
def scan_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a scan does with each path, where one folder could not be read."""
    rows = table(spark, d, "library_files")
    at = F.struct("last_seen", "id")
    known = rows.where("path < '/scan' OR path >= '/scan/c'").groupBy("path").agg(F.min_by("size_bytes", at).alias("size"), F.min("last_seen").alias("mtime"), F.min_by("error", at).alias("error"))
    found = rows.where("path < '/vault/dumps/u'").groupBy("path").agg(F.max_by("size_bytes", at).alias("size"), F.max("last_seen").alias("mtime"))
    return L.plan_scan(known, found, ["/vault/tosec"])


def _images(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit("")
    return table(spark, d, "images").select(F.col("id").alias("image_id"), "disk_id", "name", "md5", none.alias("sha1"), none.alias("sha512"), "crc32", F.col("size_bytes").alias("size"), "bad", F.col("rank_no").alias("rank"), "source")


@query("""
    WITH e AS (SELECT DISTINCT id, CASE WHEN coalesce(raw_crc32, '') <> '' THEN NULL ELSE lower(md5) END AS p_md5, CASE WHEN coalesce(raw_crc32, '') <> '' THEN lower(raw_crc32) ELSE lower(crc32) END AS p_crc, size_bytes, lower(md5) AS f_md5 FROM library_files),
    t AS (SELECT id AS image_id, lower(md5) AS md5, lower(crc32) AS crc32, size_bytes AS size, bad, rank_no FROM images),
    h AS (
      SELECT e.id, 0 AS i, 'md5' AS attempt, t.* FROM e JOIN t ON e.p_md5 = t.md5 AND t.md5 <> ''
      UNION ALL SELECT e.id, 2, 'crc32', t.* FROM e JOIN t ON e.p_crc = t.crc32 AND e.size_bytes = t.size AND t.crc32 <> ''
      UNION ALL SELECT e.id, 4, 'file md5', t.* FROM e JOIN t ON e.f_md5 = t.md5 AND t.md5 <> '')
    SELECT id, image_id, attempt FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i, bad NULLS FIRST, rank_no NULLS FIRST, image_id) AS k FROM h) WHERE k = 1""")
def dumps_of_entries(spark: SparkSession, d: str) -> DataFrame:
    """The dump that each file of the library is a copy of: by its sectors where they are known, else by the file."""
    none = F.lit(None).cast("string")
    rows = table(spark, d, "library_files").select("id", none.alias("raw_md5"), none.alias("raw_sha1"), "raw_crc32", F.lit(None).cast("long").alias("raw_size"), "md5", none.alias("sha1"), "crc32", none.alias("sha512"), "size_bytes").distinct()
    return L.match_entries(rows, _images(spark, d))


@query("""
    WITH e AS (SELECT DISTINCT id, path, coalesce(member_path, '') AS member, lower(md5) AS s, disk_id FROM library_files),
    k AS (SELECT path, coalesce(member_path, '') AS member, arg_max(lower(md5), (recorded_at, id)) AS s, max(id) % 1000 AS kept FROM library_files WHERE md5 <> '' GROUP BY ALL)
    SELECT e.id, coalesce(e.disk_id, CASE WHEN e.s = k.s THEN k.kept END) AS disk_id FROM e LEFT JOIN k ON k.path = e.path AND k.member = e.member""")
def discs_of_kept_files(spark: SparkSession, d: str) -> DataFrame:
    """The disc of each file: of its dump, else the one that it was linked to, as long as the file is still the same."""
    rows = table(spark, d, "library_files").withColumn("member", F.coalesce("member_path", F.lit("")))
    entries = rows.select("id", "path", "member", F.col("md5").alias("sha1"), F.lit("").alias("raw_sha1"), "disk_id").distinct()
    kept = rows.where("md5 <> ''").groupBy("path", "member").agg(F.max_by("md5", F.struct("recorded_at", "id")).alias("sha1"), (F.max("id") % 1000).alias("kept_disk"))
    return L.with_kept_links(entries, kept).select("id", "disk_id")


@query("""
    WITH o AS (SELECT id, platform, series_id, coalesce(number, -1) AS n, part, version FROM disks),
    g AS (SELECT * FROM disks WHERE removed_at IS NULL),
    b AS (SELECT series_id, coalesce(number, -1) AS n, part, version, min(id) AS by_number FROM g WHERE series_id <> '' GROUP BY ALL),
    w AS (SELECT o.*, b.by_number FROM o LEFT JOIN b ON b.series_id = o.series_id AND b.n = o.n AND b.part = o.part AND b.version = o.version),
    i AS (SELECT id AS image_id, disk_id, lower(md5) AS md5, lower(crc32) AS crc32, size_bytes AS size, bad, rank_no FROM images),
    m AS (SELECT *, row_number() OVER (PARTITION BY disk_id ORDER BY rank_no NULLS FIRST, image_id) AS pos FROM i WHERE disk_id IS NOT NULL),
    p AS (SELECT w.id AS key, w.platform, m.pos, m.md5, m.crc32, m.size FROM w JOIN m ON m.disk_id = w.id WHERE w.by_number IS NULL),
    h AS (
      SELECT p.key, p.pos, p.platform, 0 AS a, i.* FROM p JOIN i ON p.md5 = i.md5 AND i.md5 <> ''
      UNION ALL SELECT p.key, p.pos, p.platform, 1, i.* FROM p JOIN i ON p.crc32 = i.crc32 AND p.size = i.size AND i.crc32 <> ''),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, pos ORDER BY a, bad NULLS FIRST, rank_no NULLS FIRST, image_id) AS k FROM h) WHERE k = 1),
    u AS (SELECT t.key, arg_min(t.disk_id, (t.pos, t.disk_id)) AS by_dump FROM t JOIN g ON g.id = t.disk_id AND g.platform = t.platform GROUP BY t.key)
    SELECT w.id AS key, coalesce(w.by_number, u.by_dump) AS disk_id FROM w LEFT JOIN u ON u.key = w.id""")
def discs_found_again(spark: SparkSession, d: str) -> DataFrame:
    """Every disc looked for in the catalogue as it is after removals: by its number, else by its dumps."""
    disks = table(spark, d, "disks").select("id", "platform", "series_id", "number", "part", "version", "removed_at")
    wanted = L.identities(disks.drop("removed_at"), _images(spark, d).where("disk_id IS NOT NULL")).withColumnRenamed("disk_id", "key")
    return L.find_discs(wanted, disks.where("removed_at IS NULL").drop("removed_at"), _images(spark, d))


# Corrections


def _editable(spark: SparkSession, d: str) -> DataFrame:
    from diskloom.functions import names as N

    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    date = N.parse_date(some("date_text"))
    rows = table(spark, d, "disks").select("id", some("label").alias("label"), some("title").alias("title"), some("publisher").alias("publisher"), date.alias("_d"))
    none = F.lit("")
    return rows.select("id", "label", "title", "publisher", none.alias("cracker"), none.alias("crew"), none.alias("notes"), "_d.year", "_d.month", "_d.day")


_FORM = """
    ff AS (SELECT disk_id, field, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS value FROM (
      SELECT id AS disk_id, unnest(['label', 'title', 'publisher', 'date']) AS field, unnest([label, title || '  ' || version, upper(publisher), '19' || substr(coalesce(date_text, ''), 3)]) AS value FROM disks) WHERE value IS NOT NULL),
    now AS (SELECT id AS disk_id, unnest(['label', 'title', 'publisher', 'date']) AS field, unnest([coalesce(label, ''), coalesce(title, ''), coalesce(publisher, ''), written]) AS old FROM disks JOIN (
      SELECT id, CASE WHEN y IS NULL THEN '' ELSE y::VARCHAR || CASE WHEN m IS NULL THEN '' ELSE '-' || lpad(m::VARCHAR, 2, '0') || CASE WHEN d IS NULL THEN '' ELSE '-' || lpad(d::VARCHAR, 2, '0') END END END AS written FROM s) USING (id)),
    fr AS (SELECT ff.*, now.old, CASE WHEN regexp_full_match(value, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(value AS DATE)::VARCHAR WHEN regexp_full_match(value, '\\d{4}-\\d{2}') THEN substr(try_cast(value || '-01' AS DATE)::VARCHAR, 1, 7)
           WHEN regexp_full_match(value, '\\d{4}') THEN substr(try_cast(value || '-01-01' AS DATE)::VARCHAR, 1, 4) END AS date FROM ff JOIN now USING (disk_id, field)),
    fv AS (SELECT *, CASE WHEN field = 'label' AND value = '' THEN 'a value is needed' WHEN field = 'date' AND value <> '' AND date IS NULL THEN 'not a date' END AS problem, CASE WHEN field = 'date' AND value <> '' THEN date ELSE value END AS written FROM fr)"""


def _form(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "disks")
    fields = {"label": F.col("label"), "title": F.concat("title", F.lit("  "), "version"), "publisher": F.upper("publisher"), "date": F.concat(F.lit("19"), F.expr("substring(coalesce(date_text, ''), 3)"))}
    return rows.select(F.col("id").alias("disk_id"), F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()))).alias("x")).select("disk_id", "x.*").where("value IS NOT NULL")


def _dates() -> str:
    from diskloom.plans.form_queries import _D

    return _D


@query(f"WITH {_dates()}, {_FORM} SELECT disk_id, field, written AS value, '' AS problem FROM fv WHERE problem IS NULL AND trim(written) <> trim(old) UNION ALL SELECT disk_id, field, '', problem FROM fv WHERE problem IS NOT NULL")
def corrections_typed(spark: SparkSession, d: str) -> DataFrame:
    """The corrections in a form that differ from the catalogue, and those that cannot be taken."""
    good, bad = L.corrections_from_form(_editable(spark, d), _form(spark, d))
    return good.withColumn("problem", F.lit("")).unionByName(bad.withColumn("value", F.lit("")))


@query(f"""
    WITH {_dates()}, {_FORM}, c AS (SELECT disk_id, field, written FROM fv WHERE problem IS NULL AND trim(written) <> trim(old))
    SELECT d.id, coalesce(t.written, d.title, '') AS title, coalesce(p.written, d.publisher, '') AS publisher,
           CASE WHEN w.written IS NULL THEN s.y WHEN w.written <> '' THEN substr(w.written, 1, 4)::INTEGER END AS year, CASE WHEN w.written IS NULL THEN s.m WHEN w.written <> '' THEN nullif(substr(w.written, 6, 2), '')::INTEGER END AS month
    FROM disks d JOIN s USING (id) LEFT JOIN c t ON t.disk_id = d.id AND t.field = 'title' LEFT JOIN c p ON p.disk_id = d.id AND p.field = 'publisher' LEFT JOIN c w ON w.disk_id = d.id AND w.field = 'date'""")
def corrected_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue with those corrections in place of its values."""
    good, _ = L.corrections_from_form(_editable(spark, d), _form(spark, d))
    stored = L.store_corrections(good.where("false"), good.select("disk_id"), good)
    return L.corrected_discs(_editable(spark, d), stored).select("id", "title", "publisher", "year", "month")


@query("""
    WITH c AS (SELECT DISTINCT content_id, record_id, pos, title FROM content_records),
    o AS (SELECT *, row_number() OVER (PARTITION BY record_id, title ORDER BY pos NULLS FIRST, content_id) AS occurrence FROM c)
    SELECT content_id, CASE WHEN occurrence = 1 AND title <> '' THEN upper(title) ELSE title END AS title FROM o""")
def titles_renamed(spark: SparkSession, d: str) -> DataFrame:
    """Titles renamed by name and which one of that name on their disc they are."""
    rows = table(spark, d, "content_records").select(F.col("content_id").alias("id"), F.col("record_id").alias("disk_id"), F.col("pos").alias("position"), "title").distinct()
    renamed = rows.where("title <> ''").select("disk_id", "title", F.lit(1).alias("occurrence"), F.upper("title").alias("value")).distinct()
    return L.corrected_titles(rows, renamed).select(F.col("id").alias("content_id"), "title")


# Choosing what to use


@query("""
    WITH f AS (SELECT DISTINCT path, coalesce(member_path, '') AS member, image_id, disk_id FROM library_files WHERE disk_id IS NOT NULL)
    SELECT disk_id, path, member FROM (
      SELECT f.*, row_number() OVER (PARTITION BY f.disk_id ORDER BY coalesce(i.bad, true), i.rank_no NULLS LAST, member <> '', length(path), path, member, f.image_id NULLS FIRST) AS k
      FROM f LEFT JOIN (SELECT id, bad, rank_no FROM images) i ON i.id = f.image_id) WHERE k = 1""")
def best_files_of_discs(spark: SparkSession, d: str) -> DataFrame:
    """The file to use for each disc."""
    files = table(spark, d, "library_files").select("path", F.coalesce("member_path", F.lit("")).alias("member"), "image_id", "disk_id").distinct()
    return L.best_copies(files, _images(spark, d).select("image_id", "bad", "rank")).select("disk_id", "path", "member")


@query("""
    WITH f AS (SELECT id, arg_max(lower(md5), (recorded_at, image_id)) AS md5, arg_max(lower(crc32), (recorded_at, image_id)) AS crc32, arg_max(image_id, (recorded_at, image_id)) AS image_id FROM library_files WHERE md5 IS NOT NULL AND crc32 IS NOT NULL AND image_id IS NOT NULL GROUP BY id),
    e AS (SELECT f.id, min(CASE WHEN x.v <> CASE x.kind WHEN 'md5' THEN f.md5 ELSE f.crc32 END THEN x.kind END) AS bad, count(x.v) AS n FROM f
          JOIN (SELECT id AS image_id, unnest(['md5', 'crc32']) AS kind, unnest([lower(md5), lower(crc32)]) AS v FROM images) x ON x.image_id = f.image_id AND x.v <> '' GROUP BY f.id)
    SELECT f.id AS download_id, CASE WHEN e.id IS NULL THEN 'unchecked' ELSE coalesce(e.bad, '') END AS verdict FROM f LEFT JOIN e ON e.id = f.id""")
def downloads_verified(spark: SparkSession, d: str) -> DataFrame:
    """Whether each file has the hashes of the dump that it should be."""
    by = F.struct("recorded_at", "image_id")
    rows = table(spark, d, "library_files").where("md5 IS NOT NULL AND crc32 IS NOT NULL AND image_id IS NOT NULL").groupBy(F.col("id").alias("download_id")).agg(*(F.max_by(c, by).alias(c) for c in ("md5", "crc32", "image_id")))
    images = table(spark, d, "images").select(F.col("id").alias("image_id"), F.explode(F.array(F.struct(F.lit("md5").alias("kind"), F.col("md5").alias("value")), F.struct(F.lit("crc32").alias("kind"), F.col("crc32").alias("value")))).alias("x"))
    expected = rows.select("download_id", "image_id").join(images, "image_id").select("download_id", "x.kind", "x.value")
    return L.verify_downloads(rows.select("download_id", "md5", "crc32"), expected)


@query("""
    WITH c AS (SELECT DISTINCT record_id, content_id, pos, title FROM content_records WHERE title IS NOT NULL),
    o AS (SELECT record_id, l, pos, content_id, title FROM (SELECT *, lower(title) AS l, row_number() OVER (PARTITION BY record_id, lower(title) ORDER BY pos NULLS FIRST, content_id, title) AS r FROM c) WHERE r = 1),
    m AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY NOT contains(l, 'the'), pos NULLS FIRST, content_id) AS k FROM o)
    SELECT record_id AS disk_id, string_agg(title, ', ' ORDER BY pos NULLS FIRST, content_id) FILTER (k <= 2) || CASE WHEN count(*) > 2 THEN ' and ' || (count(*) - 2)::VARCHAR || ' more' ELSE '' END AS summary FROM m GROUP BY record_id""")
def summaries_of_discs(spark: SparkSession, d: str) -> DataFrame:
    """Two titles of each disc, those with "the" in them kept first, and how many more there are."""
    rows = table(spark, d, "content_records").where("title IS NOT NULL").select(F.col("record_id").alias("disk_id"), F.col("content_id").alias("id"), F.col("pos").alias("position"), "title").distinct()
    return L.contents_summary(rows, rows.where(F.lower("title").contains("the")), 2)


@query("""
    SELECT DISTINCT content_id, record_id, row_number() OVER (PARTITION BY record_id ORDER BY pos NULLS FIRST, content_id) AS place FROM (SELECT DISTINCT content_id, record_id, pos FROM content_records)""")
def places_of_titles(spark: SparkSession, d: str) -> DataFrame:
    """The place of each title on its disc, from 1."""
    rows = table(spark, d, "content_records").select(F.col("content_id").alias("id"), F.col("record_id").alias("disk_id"), F.col("pos").alias("position")).distinct()
    return detail.titles_in_place(rows).select(F.col("id").alias("content_id"), F.col("disk_id").alias("record_id"), F.col("place").cast("long"))


@query("""
    SELECT b.batch_id AS id, count(*) FILTER (r.status = 'done') AS done, count(*) FILTER (r.status = 'failed') AS failed, count(r.status) AS n
    FROM (SELECT batch_id FROM source_batches ORDER BY retrieved DESC NULLS LAST, batch_id DESC LIMIT 20) b LEFT JOIN (SELECT batch_id, CASE WHEN attach_only THEN 'failed' ELSE 'done' END AS status FROM disk_records) r USING (batch_id) GROUP BY b.batch_id""")
def last_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The last twenty deliveries with what became of their records."""
    sessions = table(spark, d, "source_batches").select(F.col("batch_id").alias("id"), F.col("retrieved").alias("started"))
    items = table(spark, d, "disk_records").select(F.col("batch_id").alias("session_id"), F.col("record_id").alias("at"), F.coalesce("title", F.lit("")).alias("name"), F.when(F.col("attach_only"), "failed").otherwise("done").alias("status"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return L.recent_sessions(sessions, items, 20).select("id", zero("done").alias("done"), zero("failed").alias("failed"), zero(F.size(F.coalesce("lines", F.array().cast("array<string>")))).alias("n"))


# Media, locations, notes


@query("SELECT name AS url, min(source) AS source FROM images WHERE disk_id IS NOT NULL AND disk_id IN (SELECT id FROM disks WHERE platform = 'amiga') GROUP BY name")
def addresses_of_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Every address once with the first of its sources, of the discs of one platform."""
    media = table(spark, d, "images").where("disk_id IS NOT NULL").select("id", "disk_id", F.col("name").alias("url"), "source")
    return detail.picture_addresses(media, table(spark, d, "disks"), ["amiga"])


@query("SELECT disk_id, url, id FROM (SELECT *, row_number() OVER (PARTITION BY disk_id, url ORDER BY rank_no NULLS FIRST, id) AS k FROM (SELECT disk_id, lower(name) AS url, rank_no, id FROM images WHERE disk_id IS NOT NULL)) WHERE k = 1")
def pictures_of_discs(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of each disc once for each address."""
    media = table(spark, d, "images").where("disk_id IS NOT NULL").select("id", "disk_id", F.lit(0).alias("content_id"), F.lower("name").alias("url"), "rank_no")
    return A.distinct_media(media, ["rank_no", "id"]).select("disk_id", "url", "id")


@query("""
    SELECT disk_id, url, id FROM (SELECT *, row_number() OVER (PARTITION BY disk_id, lower(trim(url)), member ORDER BY priority NULLS FIRST, id) AS k FROM (
      SELECT DISTINCT disk_id, id, path AS url, coalesce(member_path, '') AS member, size_bytes AS priority FROM library_files WHERE disk_id IS NOT NULL)) WHERE k = 1""")
def locations_of_discs(spark: SparkSession, d: str) -> DataFrame:
    """Where each disc can be had, once for each address and member."""
    rows = table(spark, d, "library_files").where("disk_id IS NOT NULL").select("disk_id", F.col("id").alias("location_id"), F.col("path").alias("url"), F.coalesce("member_path", F.lit("")).alias("member"), F.col("size_bytes").alias("priority")).distinct()
    return A.distinct_locations(rows).select("disk_id", "url", F.col("location_id").alias("id"))


@query(f"""
    WITH l AS (SELECT DISTINCT disk_id, id AS location_id, lower(md5) AS h, lower(replace(display_name, ' ', '_')) AS n FROM library_files WHERE disk_id IS NOT NULL),
    i AS (SELECT disk_id, id AS image_id, rank_no AS ord, lower(md5) AS md5, lower(crc32) AS crc32, lower(name) AS name FROM images WHERE disk_id IS NOT NULL),
    stem AS (SELECT *, CASE WHEN contains(n, '.') THEN regexp_extract(n, '^(.*)\\.[^.]*$', 1) ELSE n END AS s FROM l),
    istem AS (SELECT *, CASE WHEN contains(name, '.') THEN regexp_extract(name, '^(.*)\\.[^.]*$', 1) ELSE name END AS s FROM i),
    m AS (SELECT stem.location_id, x.ord, x.image_id FROM stem JOIN istem x ON stem.disk_id = x.disk_id AND ((stem.h <> '' AND (stem.h = x.md5 OR stem.h = x.crc32)) OR (stem.n <> '' AND (stem.n = x.name OR stem.n = x.s OR stem.s = x.name OR stem.s = x.s))))
    SELECT location_id, image_id FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY ord NULLS FIRST, image_id) AS k FROM m) WHERE k = 1""")
def dumps_of_locations(spark: SparkSession, d: str) -> DataFrame:
    """The dump of its own disc that each file names by a hash or by its name."""
    locations = table(spark, d, "library_files").where("disk_id IS NOT NULL").select("disk_id", F.col("id").alias("location_id"), F.col("md5").alias("hash_value"), F.replace("display_name", F.lit(" "), F.lit("_")).alias("image_name")).distinct()
    return A.location_images(locations, _images(spark, d).where("disk_id IS NOT NULL").withColumnRenamed("rank", "ord"))


@query("""
    WITH a AS (SELECT disk_id, 0 AS c, 'file' AS kind, path AS ref, coalesce(i.bad, false) AS bad, coalesce(i.rank_no, 2147483647) AS rank FROM (SELECT DISTINCT disk_id, path, image_id FROM library_files WHERE disk_id IS NOT NULL) f LEFT JOIN (SELECT id, bad, rank_no FROM images) i ON i.id = f.image_id),
    b AS (SELECT disk_id, 1, 'download', source || ':' || name || ':' || id, coalesce(bad, false), coalesce(rank_no, 2147483647) FROM images WHERE disk_id IS NOT NULL)
    SELECT disk_id, place, kind, ref FROM (SELECT *, row_number() OVER (PARTITION BY disk_id ORDER BY bad, c, rank, ref) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE place <= 5""")
def sources_of_discs(spark: SparkSession, d: str) -> DataFrame:
    """The five best places to take each disc from."""
    images = table(spark, d, "images")
    files = table(spark, d, "library_files").where("disk_id IS NOT NULL").select("disk_id", "path", "image_id").distinct()
    local = files.join(images.select(F.col("id").alias("image_id"), "bad", F.col("rank_no").alias("rank")), "image_id", "left")
    online = images.where("disk_id IS NOT NULL").select("disk_id", F.concat_ws(":", "source", "name", F.col("id").cast("string")).alias("url"), "bad", F.col("rank_no").alias("rank"), F.lit(0).alias("priority"))
    return A.ranked_sources(local, online).where("place <= 5").select("disk_id", F.col("place").cast("long"), "kind", "ref")


@query(f"""
    WITH n AS (SELECT content_id AS id, record_id AS disk_id, content_id, CASE WHEN kind = 'doc' THEN 'article' ELSE 'note' END AS kind, trim(extra) AS text FROM (SELECT DISTINCT content_id, record_id, kind, extra FROM content_records WHERE trim(extra) <> '')),
    g AS (SELECT content_id, bool_or(coalesce(kind = 'game', false)) AS game FROM content_records GROUP BY content_id),
    o AS (SELECT DISTINCT record_id AS disk_id, {T.normalise('notes')} AS k FROM disk_records WHERE notes IS NOT NULL),
    p AS (SELECT disk_id, content_id, kind, text, min(id) AS id FROM n GROUP BY ALL),
    a AS (SELECT disk_id, {T.normalise('text')} AS k, arg_min(p.content_id, (NOT coalesce(g.game, false), p.id, p.content_id)) AS content_id, arg_min(text, (p.id, text)) AS text, min(p.id) AS id FROM p LEFT JOIN g ON g.content_id = p.content_id WHERE p.kind = 'article' GROUP BY ALL)
    SELECT p.disk_id, p.content_id, p.kind, p.text, p.id FROM p WHERE kind <> 'article' AND NOT EXISTS (SELECT 1 FROM o WHERE o.disk_id = p.disk_id AND o.k = {T.normalise('p.text')} AND o.k <> '')
    UNION ALL SELECT disk_id, content_id, 'article', text, id FROM a""")
def notes_said_once(spark: SparkSession, d: str) -> DataFrame:
    """Notes and articles of discs, each once."""
    rows = table(spark, d, "content_records")
    notes = rows.select(F.col("content_id").alias("id"), F.col("record_id").alias("disk_id"), "content_id", F.when(F.col("kind") == "doc", "article").otherwise("note").alias("kind"), F.col("extra").alias("text")).distinct()
    kinds = rows.groupBy("content_id").agg(F.when(F.bool_or(F.coalesce(F.col("kind") == "game", F.lit(False))), "game").otherwise("").alias("kind"))
    discs = table(spark, d, "disk_records").select(F.col("record_id").alias("disk_id"), "notes").distinct()
    return A.distinct_notes(notes, kinds, discs).select("disk_id", "content_id", "kind", "text", "id")


@query(f"""
    WITH k AS (SELECT id AS item_id, platform, unnest([{T.title_key('title')}, {T.normalise(f"({T.display_title('title')})")}, {T.normalise('title')}]) AS k FROM disks WHERE title <> ''),
    c AS (SELECT DISTINCT c.record_id AS disk_id, c.content_id, r.platform, r.single, c.title FROM content_records c JOIN (SELECT record_id, min(platform) AS platform, bool_or(kind = 'single') AS single FROM disk_records GROUP BY record_id) r USING (record_id) WHERE c.title IS NOT NULL),
    t AS (SELECT disk_id, content_id, platform, single, unnest([{T.title_key('title')}, {T.normalise(f"({T.display_title('title')})")}, {T.normalise('title')}]) AS k FROM c),
    h AS (SELECT DISTINCT item_id, disk_id, content_id, single FROM k JOIN t USING (platform, k) WHERE k <> '')
    SELECT item_id, disk_id, content_id FROM h UNION SELECT item_id, disk_id, NULL FROM h WHERE single""")
def titles_meant(spark: SparkSession, d: str) -> DataFrame:
    """Every title that a disc's title stands for on its platform."""
    wanted = table(spark, d, "disks").where("title <> ''").select(F.col("id").alias("item_id"), "platform", "title")
    records = table(spark, d, "disk_records").groupBy(F.col("record_id").alias("disk_id")).agg(F.min("platform").alias("platform"), F.bool_or(F.col("kind") == "single").alias("single"))
    contents = table(spark, d, "content_records").where("title IS NOT NULL").select(F.col("record_id").alias("disk_id"), "content_id", "title").distinct().join(records, "disk_id")
    return A.title_targets(wanted, contents)


@query(f"""
    WITH g AS (SELECT {T.crew_key('name')} AS k, upper(min(name)) AS full_name FROM crew_records WHERE name IS NOT NULL GROUP BY 1),
    r AS (SELECT DISTINCT record_id, cracker FROM disk_records WHERE cracker <> ''),
    p AS (SELECT record_id, cracker, unnest(string_split(cracker, ' - ')) AS c, generate_subscripts(string_split(cracker, ' - '), 1) AS i FROM r),
    x AS (SELECT record_id, cracker, i, coalesce(g.full_name, p.c) AS v FROM p LEFT JOIN g ON g.k = {T.crew_key('p.c')}),
    u AS (SELECT record_id, cracker, v, min(i) AS i FROM x GROUP BY ALL)
    SELECT record_id, cracker, string_agg(v, ' - ' ORDER BY i) AS expanded FROM u GROUP BY ALL""")
def crews_written_out(spark: SparkSession, d: str) -> DataFrame:
    """Each crew of a list by the name that it stands for."""
    groups = table(spark, d, "crew_records").where("name IS NOT NULL").groupBy("name").agg(F.upper("name").alias("full")).select(F.col("name").alias("tag"), F.lit("").alias("platform"), "full")
    rows = table(spark, d, "disk_records").where("cracker <> ''").select("record_id", "cracker", F.lit("st").alias("platform")).distinct()
    return A.expand_groups(F.col("cracker"), groups, rows, "platform").select("record_id", "cracker", "expanded")


@query("""
    SELECT d.record_id AS disk_id, c.name, c.crew_record_id FROM (SELECT DISTINCT record_id, cracker FROM disk_records) d JOIN (SELECT min(crew_record_id) AS crew_record_id, name FROM crew_records WHERE name <> '' GROUP BY name) c ON lower(c.name) = lower(d.cracker) WHERE c.name = d.cracker""")
def crews_still_named(spark: SparkSession, d: str) -> DataFrame:
    """The crew record of each disc, only where it still has the disc's name."""
    crews = table(spark, d, "crew_records").where("name <> ''").groupBy("name").agg(F.min("crew_record_id").alias("id"))
    discs = table(spark, d, "disk_records").select(F.col("record_id").alias("disk_id"), F.col("cracker").alias("crew")).distinct()
    linked = discs.join(crews.select(F.col("id").alias("crew_id"), F.lower("name").alias("_l")), F.lower("crew") == F.col("_l")).drop("_l")
    records = crews.select("id", "name", F.lit("").alias("notes"), F.col("id").cast("string").alias("members"))
    return detail.credited_crew(linked, records).select("disk_id", "name", F.col("members").cast("long").alias("crew_record_id"))


@query("SELECT DISTINCT source AS provider, CASE source WHEN 'adfshelf' THEN 'ADF Shelf' ELSE source END AS name FROM images WHERE source NOT IN ('greylist', 'boxscans')")
def providers_switched_on(spark: SparkSession, d: str) -> DataFrame:
    """Providers that host something and are not switched off."""
    return detail.enabled_providers(table(spark, d, "images").select(F.col("source").alias("provider")), {"adfshelf": "ADF Shelf"}, ["greylist", "boxscans"])


@query("""
    SELECT disk_id, title, kind, place FROM (SELECT *, row_number() OVER (PARTITION BY disk_id ORDER BY r, title, url) AS place FROM (
      SELECT disk_id, l, arg_min(title, (r, title, url)) AS title, min(r) AS r, arg_min(url, (r, title, url)) AS url, arg_min(url, (r, title, url)) AS kind FROM (
        SELECT disk_id, lower(lang || ' ' || source) AS l, lang || ' ' || source AS title, CASE source WHEN 'web' THEN 0 WHEN 'docs' THEN 1 ELSE 2 END AS r, site AS url FROM documents WHERE disk_id IS NOT NULL AND lang IS NOT NULL AND site IS NOT NULL AND source IS NOT NULL) GROUP BY disk_id, l))""")
def articles_of_discs(spark: SparkSession, d: str) -> DataFrame:
    """Articles about each disc, its title's first, each title once."""
    rows = table(spark, d, "documents").where("disk_id IS NOT NULL AND lang IS NOT NULL AND site IS NOT NULL AND source IS NOT NULL")
    about = F.when(F.col("source") == "web", "title").when(F.col("source") == "docs", "disc").otherwise("crew")
    articles = rows.select("disk_id", F.concat_ws(" ", "lang", "source").alias("title"), F.col("site").alias("url"), about.alias("about"))
    return L.summary_articles(rows.select("disk_id").distinct(), articles).select("disk_id", "title", F.col("url").alias("kind"), F.col("place").cast("long"))


QUERIES = Q
