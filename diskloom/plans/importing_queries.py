"""Queries of the importing and assembly operators over the source tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.functions import names as N
from diskloom.operators import assembly as A
from diskloom.operators import importing as P
from diskloom.operators.relational import ranked_in
from diskloom.plans import sqltext as T
from diskloom.session import table

Q = {}
SQL = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("""
    SELECT id, series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY number NULLS FIRST, lower(version) NULLS FIRST, lower(part) NULLS FIRST, id) - 1 AS INTEGER) AS place,
           CAST((row_number() OVER (PARTITION BY series_id ORDER BY number NULLS FIRST, lower(version) NULLS FIRST, lower(part) NULLS FIRST, id) - 1) // 20 + 1 AS INTEGER) AS page
    FROM disks WHERE series_id <> ''""")
def series_listing_pages(spark: SparkSession, d: str) -> DataFrame:
    """The place and page of each disc in its series' list."""
    rows = table(spark, d, "disks").where("series_id <> ''").select("id", "series_id", "number", F.lit(None).cast("string").alias("issue"), "version", "part")
    return P.listing_pages(rows, ["series_id"], F.lit(False), "id").select("id", "series_id", "place", "page")


@query("SELECT title_id, arg_min(publisher, (received_at, content_id)) AS publisher FROM content_records WHERE title_id IS NOT NULL AND publisher <> '' GROUP BY title_id")
def first_publishers(spark: SparkSession, d: str) -> DataFrame:
    """The publisher that the earliest record of each title names."""
    return P.first_by_date(table(spark, d, "content_records").where("title_id IS NOT NULL"), ["title_id"], "publisher", "received_at", "content_id")


@query("""
    SELECT publisher, sum(n)::BIGINT AS n, coalesce(max(CASE WHEN platform = 'amiga' THEN n END), 0) AS amiga, coalesce(max(CASE WHEN platform = 'atari-st' THEN n END), 0) AS atari_st
    FROM (SELECT publisher, platform, count(*) AS n FROM disks WHERE publisher <> '' GROUP BY ALL) GROUP BY publisher""")
def releases_by_platform(spark: SparkSession, d: str) -> DataFrame:
    """How many discs each publisher has on each platform."""
    out = P.release_counts(table(spark, d, "disks"), "publisher", "platform")
    on = lambda p: F.coalesce(F.try_element_at("platforms", F.lit(p)), F.lit(0))
    return out.select("publisher", "n", on("amiga").alias("amiga"), on("atari-st").alias("atari_st"))


@query("""
    SELECT record_id, name, coalesce(arg_min(crc32, (image_record_id, crc32)) FILTER (crc32 <> ''), '') AS crc32, coalesce(arg_min(flags, (image_record_id, flags)) FILTER (flags <> ''), '') AS flags, bool_or(coalesce(bad, false)) AS bad
    FROM image_records GROUP BY record_id, name""")
def dumps_filled(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one dump of a record as one: the first checksum and flags given, bad if any row says so."""
    return A.filled_dumps(table(spark, d, "image_records"), ["record_id", "name"], ["crc32", "flags"], ["bad"], ["image_record_id"])


@query("""
    WITH r AS (SELECT DISTINCT * FROM crew_records WHERE name <> ''),
    m AS (SELECT name, trim(m) AS m, min((crew_record_id, i)) AS first_at FROM (SELECT name, crew_record_id, unnest(members) AS m, generate_subscripts(members, 1) AS i FROM r) WHERE trim(m) <> '' GROUP BY ALL),
    l AS (SELECT name, string_agg(m, ', ' ORDER BY first_at) AS members FROM m GROUP BY name),
    n AS (SELECT name, string_agg(n, chr(10) || chr(10) ORDER BY first_at) AS notes FROM (SELECT name, trim(notes) AS n, min(crew_record_id) AS first_at FROM r WHERE trim(notes) <> '' GROUP BY ALL) GROUP BY name)
    SELECT r.name, coalesce(arg_min(founded, (crew_record_id, founded)) FILTER (founded <> ''), '') AS founded, coalesce(any_value(n.notes), '') AS notes, coalesce(any_value(l.members), '') AS members
    FROM r LEFT JOIN l USING (name) LEFT JOIN n USING (name) GROUP BY r.name""")
def crews_pooled(spark: SparkSession, d: str) -> DataFrame:
    """The records of each crew name as one: members pooled, notes joined, the first founding date."""
    rows = table(spark, d, "crew_records").where("name <> ''").select("crew_record_id", "name", "founded", "notes", "members").distinct()
    return A.crew_rows(rows, ["name"], ["crew_record_id"]).select("name", "founded", "notes", F.array_join("members", ", ").alias("members"))


@query("""
    SELECT id, CASE WHEN series_id <> '' THEN coalesce(nullif(s.group_name, ''), nullif(s.name, ''), 'Unknown crew') ELSE coalesce(nullif(d.publisher, ''), 'Unknown crew') END AS crew
    FROM (SELECT id, series_id, publisher FROM disks) d LEFT JOIN (SELECT id AS sid, group_name, name FROM series_defs) s ON s.sid = d.series_id""")
def crews_of_discs(spark: SparkSession, d: str) -> DataFrame:
    """The crew that each disc belongs to."""
    series = table(spark, d, "series_defs").select(F.col("id").alias("series_id"), "group_name", "name")
    rows = table(spark, d, "disks").select("id", "series_id", "publisher").join(series, "series_id", "left")
    return rows.select("id", A.disc_crew(F.col("group_name"), F.col("name"), F.lit(""), F.col("publisher"), F.coalesce(F.col("series_id") != "", F.lit(False))).alias("crew"))


_GENERAL = "(utility|utilities|utils|tool|tools|disk|disc|system|systemdisk|games|programs|demos|board"


@query(f"""
    WITH c AS (SELECT content_id, list_filter(list_transform(string_split(min(title), ' & '), lambda p: trim(p)), lambda p: p <> '') AS ps FROM content_records WHERE contains(title, ' & ') GROUP BY content_id),
    g AS (SELECT content_id, list_filter(string_split(regexp_replace(list_aggregate(ps, 'string_agg', chr(31)), '(\\d){chr(31)}(\\d)', '\\1 & \\2', 'g'), chr(31)), lambda p: NOT regexp_full_match({T.ascii_words('p')}, '\\d+( {_GENERAL}|other|others))+')) AS ts FROM c),
    t AS (SELECT content_id, ts FROM g WHERE len(ts) >= 2 AND NOT (len(ts) = 2 AND len(list_filter(ts, lambda p: regexp_matches({T.ascii_words('p')}, '(^| ){_GENERAL})( |$)'))) > 0))
    SELECT content_id, list_aggregate(list_transform(ts, lambda p: {T.display_title('p')}), 'string_agg', ' | ') AS titles FROM t""")
def titles_joined_by_and(spark: SparkSession, d: str) -> DataFrame:
    """Titles that "&" joins, taken apart."""
    rows = table(spark, d, "content_records").where(F.col("title").contains(" & ")).groupBy("content_id").agg(F.min("title").alias("title"))
    return rows.select("content_id", P.joined_titles(F.col("title")).alias("t")).where(F.size("t") >= 2).select("content_id", F.array_join("t", " | ").alias("titles"))


@query("""
    SELECT disk_id, image_id, place FROM (
      SELECT disk_id, id AS image_id, row_number() OVER (PARTITION BY disk_id ORDER BY bad, rank_no, id) AS place FROM images WHERE disk_id IS NOT NULL AND bad IS NOT NULL AND rank_no IS NOT NULL AND removed_at IS NULL) WHERE place <= 3""")
def best_dumps(spark: SparkSession, d: str) -> DataFrame:
    """The three best dumps of each disc; each task keeps three of a disc before the shuffle."""
    rows = table(spark, d, "images").where("disk_id IS NOT NULL AND bad IS NOT NULL AND rank_no IS NOT NULL AND removed_at IS NULL").select("disk_id", F.col("id").alias("image_id"), "bad", "rank_no")
    return ranked_in(rows, ["disk_id"], ["bad", "rank_no", "image_id"], "place").where("place <= 3").select("disk_id", "image_id", F.col("place").cast("long"))


@query("""
    SELECT DISTINCT r.record_id, CASE WHEN regexp_full_match(p, '(?:disk|side|part)?\\s*[0-9]+\\s*(?:of\\s*[0-9]+)?', 'i') AND CAST(regexp_extract(p, '[0-9]+') AS INTEGER) BETWEEN 1 AND 26
           THEN chr(64 + CAST(regexp_extract(p, '[0-9]+') AS INTEGER)) WHEN regexp_full_match(p, '(?:disk|side|part)?\\s*[0-9]+\\s*(?:of\\s*[0-9]+)?', 'i') THEN CAST(CAST(regexp_extract(p, '[0-9]+') AS INTEGER) AS VARCHAR) ELSE upper(p) END AS part
    FROM (SELECT record_id, trim(part) AS p FROM disk_records WHERE part <> '') r""")
def parts_in_one_spelling(spark: SparkSession, d: str) -> DataFrame:
    """The parts of discs in one spelling."""
    return table(spark, d, "disk_records").where("part <> ''").select("record_id", N.normalise_part(F.col("part")).alias("part")).distinct()


@query("SELECT source, count(DISTINCT record_id) AS n_records, count(DISTINCT CASE WHEN attach_only THEN record_id END) AS n_attached, count(DISTINCT CASE WHEN series_key = '' THEN record_id END) AS n_without_series FROM disk_records GROUP BY source")
def build_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a build by source, in one pass."""
    rows = table(spark, d, "disk_records").dropDuplicates(["record_id"])
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.count_if("attach_only").alias("n_attached"), F.count_if(F.col("series_key") == "").alias("n_without_series"))


QUERIES = Q
