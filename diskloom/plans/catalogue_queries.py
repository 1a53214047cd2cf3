"""The find query, the ordered merge and other composed operators over the catalogue tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diskloom.functions import names as N
from diskloom.operators.merge import merge_records, place_locations, resolve_crews
from diskloom.plans.catalogue import Catalogue, build_catalogue, number_discs, open_snapshot, write_snapshot
from diskloom.plans import sqltext as T
from diskloom.plans.find import SORTS, Query, facets, search
from diskloom.session import ensure_checkpoint_dir, table
from diskloom.sources.filesystem import Store

Q = {}
SQL = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def catalogue_of(spark: SparkSession, d: str) -> Catalogue:
    """A catalogue from the tables of discs, dumps and series. Titles on discs are those of the discs themselves."""
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = table(spark, d, "disks")
    date = N.parse_date(text("date_text"))
    disks = rows.select(
        "id", text("series_id").alias("series_id"), "number", text("part").alias("part"), text("version").alias("version"), text("label").alias("label"), text("title").alias("title"), "platform", "kind",
        F.when(F.col("kind") == "pack", "Demos").otherwise("Games").alias("category"), text("publisher").alias("crew"), F.coalesce("release_year", date["year"]).alias("year"), date["month"].alias("month"), text("publisher").alias("publisher"), F.lit("").alias("cracker"), F.lit("").alias("notes"),
    ).withColumn("sort_title", N.sort_title(F.col("label")))
    contents = rows.where("title <> ''").select("id", F.col("id").alias("disk_id"), F.lit(1).alias("position"), "title", F.lit("game").alias("kind"), F.lit("").alias("extra"), text("publisher").alias("publisher"), F.lit("").alias("cracker"))
    images = table(spark, d, "images").where("disk_id IS NOT NULL").select("id", "disk_id", "name")
    locations = table(spark, d, "images").where("disk_id IS NOT NULL").select("disk_id", F.col("source").alias("provider"))
    series = table(spark, d, "series_defs").select("id", "name", "platform")
    return build_catalogue(disks, contents, images, locations, series, series.select(F.col("name").alias("alias"), F.col("id").alias("series_id")))


def snapshot_of(spark: SparkSession, d: str) -> Catalogue:
    """The catalogue of a folder of tables as a written snapshot, built again only when a file of its tables changed.

    It lies in the shared folder of checkpoints, so searches read sorted postings and skip those of other words.
    """
    ensure_checkpoint_dir(spark)
    store = Store(d, spark)
    stamps = [store.stamp(f"{d}/{t}.parquet") for t in ("disks", "images", "series_defs")]
    folder = f"{spark.sparkContext.getCheckpointDir()}/catalogue-{hashlib.sha1(repr(stamps).encode()).hexdigest()}"
    if not Store(folder, spark).exists(f"{folder}/current"):
        write_snapshot(catalogue_of(spark, d), folder, {"built_at": ""})
    return open_snapshot(spark, folder)


# SQL of the rows that a search shows: of titles (e) and of discs (d), with what they are sorted and found by.
_YEAR = "CASE WHEN try_cast(regexp_extract(date_text, '^\\s*(\\d{4})(?:[^\\d]|$)', 1) AS INTEGER) BETWEEN 1950 AND 2100 THEN try_cast(regexp_extract(date_text, '^\\s*(\\d{4})(?:[^\\d]|$)', 1) AS INTEGER) END"
_MONTH = f"CASE WHEN {_YEAR} IS NOT NULL AND try_cast(regexp_extract(date_text, '^\\s*\\d{{4}}-(\\d{{1,2}})(?:[^\\d]|$)', 1) AS INTEGER) BETWEEN 1 AND 12 THEN try_cast(regexp_extract(date_text, '^\\s*\\d{{4}}-(\\d{{1,2}})(?:[^\\d]|$)', 1) AS INTEGER) END"
_ROWS = f"""
    d AS (SELECT id, coalesce(title, '') AS title, label, coalesce(series_id, '') AS series_id, platform, kind, CASE WHEN kind = 'pack' THEN 'Demos' ELSE 'Games' END AS category, coalesce(publisher, '') AS crew, coalesce(release_year, {_YEAR}) AS year, {_MONTH} AS month, {T.sort_title('label')} AS sort FROM disks),
    e AS (SELECT id * 1048576 + CASE WHEN title <> '' THEN 1 ELSE 0 END AS id, id AS disk_id, CASE WHEN title <> '' THEN id END AS content_id, CASE WHEN title <> '' THEN {T.display_title('title')} ELSE label END AS shown, CASE WHEN title <> '' THEN 'game' ELSE kind END AS content_kind, kind, platform, crew, year FROM d),
    es AS (SELECT *, {T.sort_title('shown')} AS sort FROM e)"""
_NOCASE = "translate(crew, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ORDERS = {
    "relevance": "id", "title": "sort, id", "title-desc": "sort DESC, id DESC", "year": "year NULLS LAST, sort, id", "year-desc": "year DESC NULLS LAST, sort, id",
    "crew": f"{_NOCASE}, crew, id", "platform": "platform, sort, id", "disc": "id",
}
# SQL of the words that each index field of a row holds.
_TEXTS = f"""
    n AS (SELECT disk_id, string_agg(DISTINCT w, ' ') AS words FROM (SELECT disk_id, unnest(string_split({T.file_words('name')}, ' ')) AS w FROM images WHERE disk_id IS NOT NULL) WHERE w <> '' GROUP BY disk_id),
    s AS (SELECT id AS series_id, {T.title_search_words('name')} AS series FROM series_defs),
    x AS (SELECT d.id AS disk_id, {T.title_search_words("trim(concat_ws(' ', label, title))")} AS disk, coalesce(s.series, '') AS series, {T.search_text('crew')} AS crew_words,
                 list_distinct(list_concat({T.words(T.search_text("concat_ws(' ', platform, kind, category)"))}, {T.words("concat_ws(' ', year::VARCHAR, lpad(month::VARCHAR, 2, '0'))")})) AS facets, coalesce(n.words, '') AS files
          FROM d LEFT JOIN s USING (series_id) LEFT JOIN n ON n.disk_id = d.id)"""


@query(f"""
    WITH {_ROWS}, {_TEXTS},
    f AS (SELECT es.*, {T.words(T.title_search_words('shown'))} AS ft, {T.words("x.disk || ' ' || x.series")} AS fd, {T.words('x.crew_words')} AS fc, list_distinct({T.words('x.crew_words')}) AS fp,
                 list_distinct(list_concat(x.facets, {T.words(T.search_text('content_kind'))})) AS ff, {T.words('x.files')} AS fi FROM es JOIN x USING (disk_id)),
    l AS (SELECT *, len(ft) + len(fd) + len(fc) + len(fp) + len(ff) + len(fi) AS len, {" + ".join(f"{w}.0 * len(list_filter({c}, lambda t: starts_with(t, 'menu')))" for c, w in (("ft", 10), ("fd", 5), ("fc", 4), ("fp", 2), ("ff", 2), ("fi", 1)))} AS f FROM f),
    g AS (SELECT count(*) AS n_rows, count(*) FILTER (f > 0) AS n, sum(len) / count(*) AS mean FROM l),
    r AS (SELECT l.*, CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_rows - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)) AS score FROM l, g WHERE f > 0)
    SELECT disk_id, content_id, shown AS title, content_kind, round(score, 6) AS score FROM r
    ORDER BY CASE WHEN sort = 'menu' THEN 0 WHEN starts_with(sort, 'menu ') THEN 1 ELSE 2 END, round(score, 9) DESC, id LIMIT 100""")
def find_titles_page(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred titles for a word, ranked by bm25."""
    rows = search(snapshot_of(spark, d), Query("menu")).rows
    return rows.select("disk_id", "content_id", "title", "content_kind", F.round("score", 6).alias("score"))


@query(f"""
    WITH {_ROWS}, {_TEXTS},
    f AS (SELECT d.*, ' ' || concat_ws(' ', x.disk, x.series, {T.normalise("d.title")}, x.crew_words, list_aggregate(x.facets, 'string_agg', ' '), x.files) AS words FROM d JOIN x ON x.disk_id = d.id WHERE platform = 'amiga')
    SELECT id AS disk_id, NULL::BIGINT AS content_id, CASE WHEN title <> '' AND regexp_matches(' ' || {T.title_search_words('title')}, ' (menu|disk)') THEN title ELSE '' END AS matched FROM f
    WHERE contains(words, ' menu') AND contains(words, ' disk') ORDER BY year DESC NULLS LAST, sort, id LIMIT 50""")
def find_discs_page(spark: SparkSession, d: str) -> DataFrame:
    """A filtered page of discs for two words in a deterministic order, with the titles that a word matches."""
    rows = search(snapshot_of(spark, d), Query("menu disk", platform="amiga", mode="discs", sort="year-desc", page_size=50)).rows
    return rows.select("disk_id", "content_id", F.array_join("matched", "|").alias("matched"))


@query(f"WITH {_ROWS} " + " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, '{sort}' AS sort, {key} AS disk_id, {shown} AS title, place FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM {rows} WHERE platform = 'amiga') WHERE place > 25 AND place <= 50"
    for mode, rows, key, shown in (("titles", "es", "disk_id", "shown"), ("discs", "d", "id", "''")) for sort, order in _ORDERS.items()))
def pages_in_every_order(spark: SparkSession, d: str) -> DataFrame:
    """The second page of discs of one platform in each of the eight orders of both modes."""
    cat = snapshot_of(spark, d)
    out = None
    for mode in ("titles", "discs"):
        for sort in SORTS:
            rows = search(cat, Query(platform="amiga", mode=mode, sort=sort, page=1, page_size=25)).rows
            rows = rows.select(F.lit(mode).alias("mode"), F.lit(sort).alias("sort"), "disk_id", "title")
            rows = rows.withColumn("place", F.monotonically_increasing_id())  # a page is sorted in one partition
            out = rows if out is None else out.unionByName(rows)
    place = F.row_number().over(Window.partitionBy("mode", "sort").orderBy("place")) + 25
    return out.withColumn("place", place.cast("long"))


@query(f"""
    WITH {_ROWS}, {_TEXTS},
    f AS (SELECT es.*, ' ' || concat_ws(' ', {T.title_search_words('shown')}, x.disk, x.series, x.crew_words, list_aggregate(x.facets, 'string_agg', ' '), {T.normalise('content_kind')}, x.files) AS words FROM es JOIN x USING (disk_id))
    SELECT disk_id, content_id, shown AS title, content_kind FROM f WHERE contains(words, ' ci') AND year = 1990 ORDER BY sort DESC, id DESC LIMIT 50""")
def find_titles_of_a_year(spark: SparkSession, d: str) -> DataFrame:
    """Titles of one year that hold the beginning of a word, from the end of the alphabet."""
    return search(snapshot_of(spark, d), Query("ci", year=1990, sort="title-desc", page_size=50)).rows.select("disk_id", "content_id", "title", "content_kind")


@query("""
    SELECT facet, value, count(*) AS n FROM (
      SELECT unnest(['crew', 'category', 'year']) AS facet, unnest([publisher, CASE WHEN kind = 'pack' THEN 'Demos' ELSE 'Games' END,
        CAST(coalesce(release_year, CASE WHEN try_cast(regexp_extract(date_text, '^\\s*(\\d{4})(?:-|$)', 1) AS INTEGER) BETWEEN 1950 AND 2100 THEN try_cast(regexp_extract(date_text, '^\\s*(\\d{4})(?:-|$)', 1) AS INTEGER) END) AS VARCHAR)]) AS value FROM disks)
    WHERE value IS NOT NULL AND value <> '' GROUP BY ALL""")
def catalogue_facets(spark: SparkSession, d: str) -> DataFrame:
    """Counts of crews, categories and years."""
    return facets(catalogue_of(spark, d))


def _source_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of all sources in order of trust, with their dumps, as the merge takes them."""
    batches = table(spark, d, "source_batches").select("batch_id", F.coalesce("priority", F.lit(90)).alias("priority"))
    rows = table(spark, d, "disk_records").dropDuplicates(["record_id"]).join(batches, "batch_id", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    dumps = table(spark, d, "image_records").dropDuplicates().groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("name"), F.lit("").alias("md5"), F.lit("").alias("sha1"), F.lit("").alias("sha512"), F.regexp_replace(F.lower(text("crc32")), "^0x|[^0-9a-f]", "").alias("crc32"), F.col("size_bytes").alias("size")))).alias("images")
    )
    listed = table(spark, d, "content_records").groupBy("record_id").agg(F.count(F.lit(1)).cast("int").alias("n_contents"))
    joined = rows.join(dumps, "record_id", "left").join(listed, "record_id", "left")
    seq = F.coalesce("priority", F.lit(90)) * F.lit(1_000_000_000_000) + F.col("record_id")
    return joined.select(
        "record_id", "source", F.coalesce("priority", F.lit(90)).alias("priority"), seq.alias("seq"), "platform", "kind", text("series_key").alias("series_key"), "number", text("part").alias("part"), F.lit("").alias("version"),
        text("title").alias("title"), F.coalesce("attach_only", F.lit(False)).alias("attach_only"), F.coalesce("n_contents", F.lit(0)).alias("n_contents"), F.lit(0).alias("n_media"), "images",
        F.array().cast("array<struct<url:string,member:string,image_name:string,hash_kind:string,hash_value:string,size:bigint>>").alias("locations"),
    )


@query()
def merge_disc_records(spark: SparkSession, d: str) -> DataFrame:
    """The disc that each source record belongs to, by key and by dumps."""
    return merge_records(_source_records(spark, d)).select("record_id", "disc", "way")


@query("""
    WITH l AS (SELECT DISTINCT id AS location_id, lower(raw_crc32) AS crc32, size_bytes FROM library_files WHERE raw_crc32 <> '')
    SELECT l.location_id, min(i.id) AS image_id FROM l JOIN images i ON l.crc32 = lower(i.crc32) AND (l.size_bytes IS NULL OR l.size_bytes = i.size_bytes) GROUP BY l.location_id""")
def place_files_on_dumps(spark: SparkSession, d: str) -> DataFrame:
    """The dump of each file by its checksum and size."""
    files = table(spark, d, "library_files").where("raw_crc32 <> ''").select(F.col("id").alias("location_id"), F.lit("crc32").alias("hash_kind"), F.col("raw_crc32").alias("hash_value"), F.col("size_bytes").alias("size"), F.lit("").alias("name")).distinct()
    images = table(spark, d, "images").select(F.col("id").alias("image_id"), F.col("id").alias("ord"), "name", "md5", F.lit("").alias("sha1"), F.lit("").alias("sha512"), "crc32", F.col("size_bytes").alias("size"))
    return place_locations(files, images)


@query(f"""
    WITH c AS (SELECT crew_record_id, {T.crew_key('name')} AS key, source, p.platform, p.releases FROM (SELECT DISTINCT crew_record_id, name, source, platforms FROM crew_records) x,
      LATERAL (SELECT unnest(map_keys(x.platforms)) AS platform, unnest(map_values(x.platforms)) AS releases) p),
    d AS (SELECT record_id AS disk_id, {T.crew_key('cracker')} AS key, platform FROM (SELECT record_id, min(cracker) AS cracker, min(platform) AS platform FROM disk_records GROUP BY record_id)),
    f AS (SELECT disk_id, source, crew_record_id, releases FROM d JOIN c USING (key, platform) WHERE key <> ''),
    g AS (SELECT disk_id, source, count(*) AS n, min(crew_record_id) AS one, arg_min(crew_record_id, (-releases, crew_record_id)) AS top, max(releases) AS most, sum(releases) AS total FROM f GROUP BY ALL)
    SELECT disk_id, source, CASE WHEN n = 1 THEN one ELSE top END AS crew_record_id, CASE WHEN n = 1 THEN 'only' ELSE 'dominant' END AS way FROM g WHERE n = 1 OR (most >= 10 AND most >= 0.9 * total)""")
def crews_of_records(spark: SparkSession, d: str) -> DataFrame:
    """The record of each source that describes the crew of each disc record."""
    crews = table(spark, d, "crew_records").select("crew_record_id", "name", "source", F.map_entries("platforms").alias("p")).distinct()
    crews = crews.select("crew_record_id", "name", "source", F.explode("p").alias("p")).select("crew_record_id", "name", "source", F.col("p.key").alias("platform"), F.col("p.value").alias("releases"))
    discs = table(spark, d, "disk_records").groupBy(F.col("record_id").alias("disk_id")).agg(F.min("cracker").alias("crew"), F.min("platform").alias("platform"))
    empty = spark.createDataFrame([], "disk_id long, crew_record_id long")
    pins = spark.createDataFrame([], "key string, platform string, source string, crew_record_id long")
    return resolve_crews(discs, crews, empty, pins)


@query("""
    SELECT id, CAST(row_number() OVER (ORDER BY platform, CASE WHEN series_id <> '' THEN 0 ELSE 1 END, number IS NULL, number, id) AS BIGINT) AS n FROM (
      SELECT id, platform, coalesce(series_id, '') AS series_id, number FROM disks)""")
def numbers_in_disc_order(spark: SparkSession, d: str) -> DataFrame:
    """Every disc's dense number in one global order."""
    rows = table(spark, d, "disks").select(F.col("id").alias("sequence"), "platform", F.coalesce("series_id", F.lit("")).alias("series_id"), F.lit("").alias("series_name"), "number", F.lit("").alias("part"), F.lit("").alias("version"), F.lit("").alias("label"))
    return number_discs(rows).select(F.col("sequence").alias("id"), F.col("id").alias("n"))


QUERIES = Q
