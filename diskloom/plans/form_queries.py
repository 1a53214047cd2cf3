"""Queries of the text, date, address and hash forms over the names of the catalogue, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.functions import names as N
from diskloom.functions.dumpnames import dump_name
from diskloom.operators import assembly as A
from diskloom.operators import boot
from diskloom.plans import sqltext as T
from diskloom.session import table
from diskloom.sources.files import hash_keys, with_hashes

Q = {}
SQL = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def _sorted(c):
    return F.array_join(F.array_sort(c), " ")


@query(f"""
    SELECT DISTINCT content_id, {T.normalise('title')} AS plain, {T.tokens('title')} AS tokens, {T.search_text('title')} AS searched, {T.title_search_words('title')} AS search_words
    FROM content_records""")
def search_forms_of_titles(spark: SparkSession, d: str) -> DataFrame:
    """The forms in which titles are compared and searched."""
    t = F.col("title")
    return table(spark, d, "content_records").select("content_id", N.normalise(t).alias("plain"), F.array_join(N.tokens(t), " ").alias("tokens"), N.search_text(t).alias("searched"), _sorted(N.words_of(N.title_search_text(t))).alias("search_words")).distinct()


@query(f"""
    SELECT DISTINCT content_id, {T.display_title('title')} AS shown, {T.title_key('title')} AS key, {T.sort_title('title')} AS sorted_by,
           list_aggregate(list_sort({T.title_words('title')}), 'string_agg', ' ') AS telling
    FROM content_records WHERE title IS NOT NULL""")
def key_forms_of_titles(spark: SparkSession, d: str) -> DataFrame:
    """The forms in which titles are shown, joined and sorted."""
    t = F.col("title")
    rows = table(spark, d, "content_records").where("title IS NOT NULL")
    return rows.select("content_id", N.display_title(t).alias("shown"), N.title_key(t).alias("key"), N.sort_title(t).alias("sorted_by"), F.nullif(_sorted(N.title_words(t)), F.lit("")).alias("telling")).distinct()


@query(f"""
    SELECT id, replace({T.ascii_words('name')}, ' ', '-') AS slug, {T.crew_key('group_name')} AS crew, {T.ascii_words('name')} AS words FROM series_defs""")
def identifiers_of_series(spark: SparkSession, d: str) -> DataFrame:
    """Stable identifiers and comparison keys of series and their crews."""
    return table(spark, d, "series_defs").select("id", N.slug(F.col("name")).alias("slug"), N.crew_key(F.col("group_name")).alias("crew"), N.ascii_words(F.col("name")).alias("words"))


@query("""
    SELECT DISTINCT content_id, CASE WHEN major = '' THEN v WHEN number = '1' THEN '' ELSE 'v' || number END AS version FROM (
      SELECT *, coalesce(nullif(ltrim(major, '0'), ''), '0') || CASE WHEN rtrim(minor, '0') <> '' THEN '.' || rtrim(minor, '0') ELSE '' END AS number FROM (
        SELECT content_id, v, regexp_extract(v, '(\\d+)(?:\\.(\\d+))?', 1) AS major, regexp_extract(v, '(\\d+)(?:\\.(\\d+))?', 2) AS minor FROM (
          SELECT content_id, CASE lower(trim(version)) WHEN 'bis' THEN '2' WHEN 'ter' THEN '3' WHEN 'quater' THEN '4' ELSE lower(trim(version)) END AS v FROM content_records)))""")
def versions_in_one_spelling(spark: SparkSession, d: str) -> DataFrame:
    """The versions of titles in one spelling."""
    return table(spark, d, "content_records").select("content_id", N.normalise_version(F.col("version")).alias("version")).distinct()


@query("""
    SELECT DISTINCT content_id, list_aggregate(list_filter(list_transform(regexp_split_to_array(regexp_extract(x, '(?:^|\\s)aka\\s+(.+)$', 1, 'i'), '\\s*;\\s*'), lambda t: trim(t)), lambda t: t <> ''), 'string_agg', '|') AS names
    FROM (SELECT content_id, 'aka ' || title || '; ' || coalesce(extra, '') AS x FROM content_records WHERE title IS NOT NULL)""")
def other_titles(spark: SparkSession, d: str) -> DataFrame:
    """Other titles read from remarks such as "aka First; Second"."""
    rows = table(spark, d, "content_records").where("title IS NOT NULL").select("content_id", F.concat(F.lit("aka "), "title", F.lit("; "), F.coalesce("extra", F.lit(""))).alias("x"))
    return rows.select("content_id", F.nullif(F.array_join(N.akas(F.col("x")), "|"), F.lit("")).alias("names")).distinct()


@query("""
    SELECT id, regexp_extract(p, '([^/]*)/*$', 1) AS base, lower(regexp_extract(regexp_extract(p, '([^/]*)/*$', 1), '\\.([^.]+)$', 1)) AS suffix,
           coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(p, '([^/]*)/*$', 1), '[\\x00-\\x1f<>:"|?*]', '_', 'g'), '^[\\s.]+|[\\s.]+$', '', 'g'), '\\s+', ' ', 'g'), ''), 'download') AS safe
    FROM (SELECT DISTINCT id, replace(path, '\\', '/') AS p FROM library_files)""")
def safe_names_of_files(spark: SparkSession, d: str) -> DataFrame:
    """The base name, suffix and a name that any file system takes of each file."""
    p = F.col("path")
    return table(spark, d, "library_files").select("id", N.base_name(p).alias("base"), N.suffix_of(p).alias("suffix"), N.sanitise_name(p).alias("safe")).distinct()


@query("""
    SELECT disk_id, string_agg(DISTINCT w, ' ' ORDER BY w) AS words FROM (
      SELECT disk_id, unnest(list_filter(string_split(lower(regexp_replace(name, '[^0-9A-Za-z]+', ' ', 'g')), ' '), lambda w: w <> '')) AS w FROM images WHERE disk_id IS NOT NULL) GROUP BY disk_id""")
def words_of_file_names(spark: SparkSession, d: str) -> DataFrame:
    """The search words of each disc's file names."""
    names = table(spark, d, "images").where("disk_id IS NOT NULL").groupBy("disk_id").agg(F.collect_set("name").alias("names"))
    return names.select("disk_id", _sorted(N.words_of(N.file_name_words(F.col("names")))).alias("words")).where("words <> ''")


@query("""
    SELECT crew_record_id, string_agg(w, ' ' ORDER BY i) AS words FROM (
      SELECT crew_record_id, w, min(i) AS i FROM (
        SELECT crew_record_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
          SELECT DISTINCT crew_record_id, list_filter(string_split(regexp_replace(trim(notes || ' ' || notes), '\\s+', ' ', 'g'), ' '), lambda w: w <> '') AS ws FROM crew_records WHERE notes <> '')) GROUP BY ALL) GROUP BY crew_record_id""")
def words_said_once(spark: SparkSession, d: str) -> DataFrame:
    """Each word of a crew's notes once, in order of first appearance."""
    rows = table(spark, d, "crew_records").where("notes <> ''").select("crew_record_id", "notes").distinct()
    return rows.select("crew_record_id", N.distinct_words(F.concat_ws(" ", "notes", "notes")).alias("words"))


_D = """
    p AS (SELECT id, date_text, regexp_extract(date_text, '^\\s*(\\d{4})(?:[^\\d]|$)', 1) AS ys, regexp_extract(date_text, '^\\s*\\d{4}-(\\d{1,2}|[xX?]{2})(?:[^\\d]|$)', 1) AS ms,
                 regexp_extract(date_text, '^\\s*\\d{4}-(?:\\d{1,2}|[xX?]{2})-(\\d{1,2}|[xX?]{2})(?:[^\\d]|$)', 1) AS ds FROM disks),
    q AS (SELECT *, CASE WHEN try_cast(ys AS INTEGER) BETWEEN 1950 AND 2100 THEN try_cast(ys AS INTEGER) END AS y FROM p),
    r AS (SELECT *, CASE WHEN y IS NOT NULL AND try_cast(ms AS INTEGER) BETWEEN 1 AND 12 THEN try_cast(ms AS INTEGER) END AS m FROM q),
    s AS (SELECT *, CASE WHEN m IS NOT NULL AND try_cast(ds AS INTEGER) BETWEEN 1 AND 31 THEN try_cast(ds AS INTEGER) END AS d FROM r)"""


@query(f"""
    WITH {_D}
    SELECT id, CASE WHEN y IS NULL THEN '' ELSE y::VARCHAR || CASE WHEN m IS NULL THEN '' ELSE '-' || lpad(m::VARCHAR, 2, '0') || CASE WHEN d IS NULL THEN '' ELSE '-' || lpad(d::VARCHAR, 2, '0') END END END AS written,
           concat_ws(' ', y::VARCHAR, lpad(m::VARCHAR, 2, '0')) AS words, CASE WHEN y IS NULL THEN 0 WHEN m IS NULL THEN 1 WHEN d IS NULL THEN 2 ELSE 3 END AS exact FROM s""")
def partial_dates(spark: SparkSession, d: str) -> DataFrame:
    """Partial dates read, written out, as search words, and how exact they are."""
    date = N.parse_date(F.coalesce("date_text", F.lit("")))
    return table(spark, d, "disks").select("id", N.date_text(date).alias("written"), N.date_words(date).alias("words"), N.precision(date).alias("exact"))


@query("""
    SELECT id, CASE WHEN regexp_full_match(t, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(t AS DATE)::VARCHAR WHEN regexp_full_match(t, '\\d{4}-\\d{2}') THEN substr(try_cast(t || '-01' AS DATE)::VARCHAR, 1, 7)
           WHEN regexp_full_match(t, '\\d{4}') THEN substr(try_cast(t || '-01-01' AS DATE)::VARCHAR, 1, 4) END AS date FROM (SELECT id, trim(date_text) AS t FROM disks)""")
def typed_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates that a correction may give: every part must exist in the calendar, NULL otherwise."""
    return table(spark, d, "disks").select("id", F.nullif(N.date_text(N.strict_date(F.col("date_text"))), F.lit("")).alias("date"))


@query("""
    SELECT DISTINCT doc_id, lower(trim(url_decode(replace(u, '+', '%2B')))) AS key, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host
    FROM (SELECT doc_id, regexp_extract(text, '(https?://[A-Za-z0-9./:_-]+)', 1) AS u FROM documents) WHERE u <> ''""")
def addresses_in_documents(spark: SparkSession, d: str) -> DataFrame:
    """The comparison key and the host of the first address in each document."""
    rows = table(spark, d, "documents").select("doc_id", F.regexp_extract("text", "(https?://[A-Za-z0-9./:_-]+)", 1).alias("u")).where("u <> ''")
    return rows.select("doc_id", N.url_key(F.col("u")).alias("key"), N.host_of(F.col("u")).alias("host")).distinct()


@query("""
    WITH f AS (SELECT DISTINCT image_record_id, regexp_extract_all(name || flags, '\\[([^\\]]*)\\]', 1) AS fs, bad FROM image_records)
    SELECT image_record_id, CASE WHEN len(list_filter(fs, lambda f: regexp_matches(f, '^b\\d*(\\s|$)'))) > 0 THEN 2 WHEN len(list_filter(fs, lambda f: regexp_matches(f, '^[hmfouvp]\\d*(\\s|$)') OR regexp_matches(f, '^t( |$)'))) > 0 THEN 1 ELSE 0 END AS worse,
           CASE WHEN a IS NULL THEN 0 ELSE coalesce(nullif(regexp_extract(a, '^a(\\d*)', 1), ''), '1')::INTEGER END AS alternate, CASE WHEN list_contains(fs, '!') THEN 0 ELSE 1 END AS unverified
    FROM (SELECT *, list_filter(fs, lambda f: regexp_matches(f, '^a\\d*(\\s|$)'))[1] AS a FROM f)""")
def ranks_by_flags(spark: SparkSession, d: str) -> DataFrame:
    """The rank of dumps by their flags: damaged or changed, alternates, verified."""
    rows = table(spark, d, "image_records").select("image_record_id", N.dump_flags(F.concat("name", "flags")).alias("f"), "bad").distinct()
    return rows.select("image_record_id", N.image_rank_key(F.col("f")).alias("k")).where("k IS NOT NULL").select("image_record_id", "k.*")


@query(f"""
    SELECT d.id, {T.label('s.label', 's.name', 'd.number', 'd.part', 'd.version')} AS label
    FROM disks d LEFT JOIN series_defs s ON s.id = d.series_id""")
def labels_of_discs(spark: SparkSession, d: str) -> DataFrame:
    """The label of each disc by its series' template, else its title with the part, else a stand-in."""
    series = table(spark, d, "series_defs").select(F.col("id").alias("series_id"), F.col("label").alias("template"), F.col("name").alias("series_name"))
    some = lambda c: F.coalesce(c, F.lit(""))
    rows = table(spark, d, "disks").join(F.broadcast(series), "series_id", "left")  # the list of series, fixed in size
    return rows.select("id", A.disc_label(F.col("template"), some("series_name"), F.col("number"), some("part"), some("version"), some("title")).alias("label"))


_CLEAN = "trim(regexp_replace(regexp_replace(coalesce({0}, ''), '[^\\x20-\\x7e]|[()\\[\\]&]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _clean(c: str):
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[^\x20-\x7e]|[()\[\]&]", " "), r"\s+", " "))


@query(f"""
    SELECT id, regexp_replace(t, ' +', ' ', 'g') AS title, '1990-05' AS date, p AS publisher, 'st' AS extension, 'cr Some Crew|a2' AS flags, 2 AS alternate, 1 AS disk, 2 AS disks
    FROM (SELECT id, 'X ' || {_CLEAN.format('title')} || ' Y' AS t, 'P ' || {_CLEAN.format('publisher')} AS p FROM disks)""")
def dump_names_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Dump names put together from what is known of each disc, and taken apart again."""
    rows = table(spark, d, "disks").select("id", F.concat(F.lit("X "), _clean("title"), F.lit(" Y (1990-05)("), F.trim(F.concat(F.lit("P "), _clean("publisher"))), F.lit(")(Disk 1 of 2)[cr Some Crew][a2].st")).alias("name"))
    rows = rows.select("id", dump_name(F.col("name")).alias("n"))
    return rows.select("id", F.regexp_replace("n.title", r"\s+", " ").alias("title"), "n.date", F.rpad(F.col("n.publisher"), F.greatest(F.length("n.publisher"), F.lit(2)), " ").alias("publisher"), "n.extension", F.array_join("n.flags", "|").alias("flags"), "n.alternate", "n.disk", "n.disks")


@query(f"""
    SELECT id, 'X ' || {_CLEAN.format('title')} || ' (1990)(A)[a] | Y ' || {_CLEAN.format('label')} || ' (199x-xx)(B)' AS titles FROM disks""")
def combined_entries(spark: SparkSession, d: str) -> DataFrame:
    """Names that list two titles with their dates, taken apart."""
    rows = table(spark, d, "disks").select("id", F.concat(F.lit("X "), _clean("title"), F.lit(" (1990)(A)[a] & Y "), _clean("label"), F.lit(" (199x-xx)(B)")).alias("name"))
    return rows.select("id", F.array_join(N.split_combined(F.col("name")), " | ").alias("titles"))


@query("SELECT DISTINCT doc_id, octet_length(encode(text)) AS size_bytes, md5(text) AS md5, sha1(text) AS sha1 FROM documents WHERE text IS NOT NULL")
def hashes_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Size and hashes of the bytes of each document."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return with_hashes(rows).select("doc_id", "size_bytes", "md5", "sha1").distinct()


@query("""
    SELECT id, list_aggregate(list_sort(list_filter([CASE WHEN md5 <> '' THEN 'md5:' || lower(md5) END, CASE WHEN crc32 <> '' AND size_bytes IS NOT NULL THEN 'crc:' || lower(crc32) || ':' || size_bytes::VARCHAR END], lambda k: k IS NOT NULL)), 'string_agg', ' ') AS keys
    FROM images""")
def hash_keys_of_images(spark: SparkSession, d: str) -> DataFrame:
    """The keys by which two dumps are one."""
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    keys = hash_keys(some("md5"), F.lit(""), F.lit(""), some("crc32"), F.col("size_bytes"))
    return table(spark, d, "images").select("id", F.nullif(_sorted(keys), F.lit("")).alias("keys"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "disks").select("id", F.encode(N.ascii_words(F.col("label")), "UTF-8").alias("boot"))


@query(f"""
    WITH b AS (SELECT id, {T.ascii_words('label')} AS boot FROM disks),
    s AS (SELECT row_number() OVER (ORDER BY id) AS ord, id AS name, {T.ascii_words('name')} AS t FROM series_defs),
    w AS (SELECT ord, name, 0 AS o, 8 AS n, sha1(substr(t, 1, 8)) AS h FROM s WHERE length(t) >= 8 UNION ALL SELECT ord + 1000, name, 4, 6, sha1(substr(t, 5, 6)) FROM s WHERE length(t) >= 10)
    SELECT b.id, arg_min(w.name, w.ord) AS name FROM b JOIN w ON sha1(substr(b.boot, w.o + 1, w.n)) = w.h GROUP BY b.id""")
def windows_of_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks known by the hash of a window, the first signature of several."""
    from pyspark.sql import Window

    s = table(spark, d, "series_defs").select(F.row_number().over(Window.orderBy("id")).alias("ord"), F.col("id").alias("name"), N.ascii_words(F.col("name")).alias("t"))  # the list of series, fixed in size
    cut = lambda least, o, n, add: s.where(F.length("t") >= least).select((F.col("ord") + add).alias("ord"), "name", F.lit(o).alias("offset"), F.lit(n).alias("length"), F.sha1(F.encode(F.substring("t", o + 1, n), "UTF-8")).alias("sha1"))
    return boot.match_windows(_blocks(spark, d), boot.valid_signatures(cut(8, 0, 8, 0).unionByName(cut(10, 4, 6, 1000)), 1024))


@query(f"""
    WITH b AS (SELECT id, {T.ascii_words('label')} AS boot FROM disks),
    h AS (SELECT id, list_filter([CASE WHEN starts_with(boot, 'the') AND substr(boot, 4, 1) = ' ' THEN 'article' END, CASE WHEN substr(boot, 3, 1) = 'a' THEN 'third a' END, CASE WHEN substr(boot, 2, 1) = 'o' AND substr(boot, 5, 1) = 'e' THEN 'o and e' END], lambda x: x IS NOT NULL) AS names FROM b)
    SELECT id, names[1] AS name FROM h WHERE len(names) = 1""")
def markers_of_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks known by bytes at places, where all markers of exactly one name fit."""
    markers = [("article", 0, "746865"), ("article", 3, "20"), ("third a", 2, "61"), ("o and e", 1, "6f"), ("o and e", 4, "65")]
    return boot.match_markers(_blocks(spark, d), spark.createDataFrame(markers, "name string, offset int, bytes string"))


_LOWER_WORDS = "array_to_string(list_filter(regexp_split_to_array(lower(trim({0})), '[^a-z0-9]+'), lambda w: true), ' ')"


@query(f"""
    WITH l AS (SELECT DISTINCT label, {_LOWER_WORDS.format('label')} AS k FROM disks), s AS (SELECT {_LOWER_WORDS.format('name')} AS p, min(id) AS series FROM series_defs GROUP BY 1),
    h AS (SELECT l.label, arg_max(s.series, length(s.p)) AS series FROM l JOIN s ON l.k = s.p OR starts_with(l.k, s.p || ' ') GROUP BY l.label)
    SELECT d.id, h.series FROM disks d LEFT JOIN h ON h.label = d.label""")
def longest_series_names(spark: SparkSession, d: str) -> DataFrame:
    """The series whose name is the longest with which each label begins."""
    prefixes = table(spark, d, "series_defs").groupBy(F.array_join(F.split(F.lower(F.trim("name")), r"[^a-z0-9]+"), " ").alias("prefix")).agg(F.min("id").alias("series"))
    return boot.longest_prefix(table(spark, d, "disks").select("id", "label"), "label", prefixes).select("id", "series")


QUERIES = Q
