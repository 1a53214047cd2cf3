"""Queries of the relational operators over the catalogue tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.functions import names as N
from diskloom.operators import relational as R
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


# Filters, semi- and anti-joins


@query("SELECT id, label, kind, release_year FROM disks WHERE platform = 'amiga' AND kind IN ('menu', 'pack') AND release_year BETWEEN 1988 AND 1992 AND removed_at IS NULL")
def filter_discs(spark: SparkSession, d: str) -> DataFrame:
    """Equality, list and range filters, pushed to the scan."""
    rows = table(spark, d, "disks")
    return rows.where((F.col("platform") == "amiga") & F.col("kind").isin("menu", "pack") & F.col("release_year").between(1988, 1992) & F.col("removed_at").isNull()).select("id", "label", "kind", "release_year")


@query("SELECT id, platform, kind FROM disks d WHERE EXISTS (SELECT 1 FROM library_files f WHERE f.disk_id = d.id)")
def semi_available_discs(spark: SparkSession, d: str) -> DataFrame:
    """Discs that the library holds."""
    return table(spark, d, "disks").join(table(spark, d, "library_files").where("disk_id IS NOT NULL").select(F.col("disk_id").alias("id")).distinct(), "id", "left_semi").select("id", "platform", "kind")


@query("SELECT id, platform FROM disks d WHERE NOT EXISTS (SELECT 1 FROM images i WHERE i.disk_id = d.id)")
def anti_discs_without_images(spark: SparkSession, d: str) -> DataFrame:
    """Discs of which no dump is known."""
    return table(spark, d, "disks").join(table(spark, d, "images").select(F.col("disk_id").alias("id")).distinct(), "id", "left_anti").select("id", "platform")


@query("""
    SELECT d.id, CASE WHEN f.id IS NOT NULL THEN 'local' WHEN i.id IS NOT NULL THEN 'online' ELSE 'none' END AS availability
    FROM disks d LEFT JOIN (SELECT DISTINCT disk_id AS id FROM library_files) f ON f.id = d.id
    LEFT JOIN (SELECT DISTINCT disk_id AS id FROM images WHERE NOT bad AND removed_at IS NULL) i ON i.id = d.id""")
def availability_of_discs(spark: SparkSession, d: str) -> DataFrame:
    """Local if a file is there, else online if a good dump is known, else none."""
    have = table(spark, d, "library_files").where("disk_id IS NOT NULL").select(F.col("disk_id").alias("id")).distinct().withColumn("_l", F.lit(True))
    known = table(spark, d, "images").where("NOT bad AND removed_at IS NULL").select(F.col("disk_id").alias("id")).distinct().withColumn("_o", F.lit(True))
    both = table(spark, d, "disks").select("id").join(have, "id", "left").join(known, "id", "left")
    return both.select("id", F.when(F.col("_l"), "local").when(F.col("_o"), "online").otherwise("none").alias("availability"))


@query("SELECT s.id AS series_id, s.name, count(d.id) AS n_discs FROM series_defs s LEFT JOIN disks d ON d.series_id = s.id GROUP BY ALL")
def series_with_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every series with its number of discs, 0 included; discs are counted before the join."""
    counts = table(spark, d, "disks").groupBy("series_id").agg(F.count(F.lit(1)).alias("n_discs"))
    return table(spark, d, "series_defs").select(F.col("id").alias("series_id"), "name").join(counts, "series_id", "left").select("series_id", "name", F.coalesce("n_discs", F.lit(0)).alias("n_discs"))


# Facets and statistics


@query("""
    SELECT facet, value, count(*) AS n FROM (
      SELECT unnest(['platform', 'kind', 'publisher', 'year']) AS facet, unnest([platform, kind, publisher, CAST(release_year AS VARCHAR)]) AS value FROM disks)
    WHERE value IS NOT NULL AND value <> '' GROUP BY ALL""")
def facets_of_discs(spark: SparkSession, d: str) -> DataFrame:
    """Counts of four facets in one pass."""
    return R.counts_by(table(spark, d, "disks"), {"platform": F.col("platform"), "kind": F.col("kind"), "publisher": F.col("publisher"), "year": F.col("release_year")})


_FIRST_YEAR = "SELECT d.id, min(CAST(strftime(f.last_seen, '%Y') AS INTEGER)) AS y FROM disks d JOIN library_files f ON f.disk_id = d.id WHERE d.release_year IS NULL GROUP BY d.id"


def _year_overrides(spark: SparkSession, d: str) -> DataFrame:
    """For discs without a year, the year in which a file of them was first seen."""
    seen = table(spark, d, "library_files").where("disk_id IS NOT NULL").groupBy(F.col("disk_id").alias("id")).agg(F.min(F.year("last_seen")).alias("release_year"))
    return seen.join(table(spark, d, "disks").where("release_year IS NULL").select("id"), "id", "left_semi")


@query(f"SELECT 'year' AS facet, CAST(coalesce(d.release_year, o.y) AS VARCHAR) AS value, count(*) AS n FROM disks d LEFT JOIN ({_FIRST_YEAR}) o ON o.id = d.id WHERE coalesce(d.release_year, o.y) IS NOT NULL GROUP BY ALL")
def facets_with_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Year counts in which corrected discs count under the corrected year."""
    rows = R.with_overrides(table(spark, d, "disks").select("id", "release_year"), "id", _year_overrides(spark, d), ["release_year"])
    return R.counts_by(rows, {"year": F.col("release_year")})


@query(f"SELECT d.id, coalesce(d.release_year, o.y) AS release_year FROM disks d LEFT JOIN ({_FIRST_YEAR}) o ON o.id = d.id WHERE coalesce(d.release_year, o.y) >= 1995")
def filter_by_overridden_year(spark: SparkSession, d: str) -> DataFrame:
    """A filter that sees corrected values in place of the catalogue's."""
    return R.with_overrides(table(spark, d, "disks").select("id", "release_year"), "id", _year_overrides(spark, d), ["release_year"]).where("release_year >= 1995")


@query("SELECT platform, kind, count(*) AS n FROM disks GROUP BY GROUPING SETS ((platform, kind), (platform), (kind), ())")
def stats_by_platform_and_kind(spark: SparkSession, d: str) -> DataFrame:
    """Counts in three groupings and the total, in one pass."""
    return table(spark, d, "disks").groupingSets([["platform", "kind"], ["platform"], ["kind"], []], "platform", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT disk_id, count(*) AS n_files, count(image_id) AS n_matched, count(DISTINCT CASE WHEN md5 <> '' THEN md5 ELSE crc32 END) AS n_different, max(last_seen) AS last_seen
    FROM (SELECT DISTINCT * FROM library_files) WHERE disk_id IS NOT NULL GROUP BY disk_id""")
def library_counts_by_disc(spark: SparkSession, d: str) -> DataFrame:
    """Files, matched files, different contents and the last sighting of each disc; repeated rows count once."""
    rows = table(spark, d, "library_files").where("disk_id IS NOT NULL").dropDuplicates()
    return rows.groupBy("disk_id").agg(F.count(F.lit(1)).alias("n_files"), F.count("image_id").alias("n_matched"), F.countDistinct(F.when(F.col("md5") != "", F.col("md5")).otherwise(F.col("crc32"))).alias("n_different"), F.max("last_seen").alias("last_seen"))


@query("SELECT DISTINCT source, status FROM source_batches")
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    """Different pairs of source and status."""
    return table(spark, d, "source_batches").select("source", "status").distinct()


# Merging values of several sources


_RECORDS = "(SELECT DISTINCT r.*, coalesce(b.priority, 90) AS pr FROM disk_records r LEFT JOIN source_batches b USING (batch_id) WHERE series_key <> '' AND number IS NOT NULL)"


def _records(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "source_batches").select("batch_id", "priority")
    rows = table(spark, d, "disk_records").where("series_key <> '' AND number IS NOT NULL").dropDuplicates()
    return rows.join(known, "batch_id", "left").withColumn("pr", F.coalesce("priority", F.lit(90)))


@query(f"""
    SELECT series_key, number, coalesce(arg_min(title, (pr, record_id, title)) FILTER (title <> ''), '') AS title,
           coalesce(arg_min(kind, (pr, record_id, kind)) FILTER (kind <> ''), '') AS kind, coalesce(arg_min(cracker, (pr, record_id, cracker)) FILTER (cracker <> ''), '') AS cracker
    FROM {_RECORDS} GROUP BY series_key, number""")
def keyed_merge_first_values(spark: SparkSession, d: str) -> DataFrame:
    """The records of each numbered disc merged: each field from the most trusted source that gives it."""
    return R.first_present(_records(spark, d), ["series_key", "number"], ["title", "kind", "cracker"], ["pr", "record_id"])


@query(f"""
    SELECT series_key, number, string_agg(notes, chr(10) ORDER BY first_at) AS notes FROM (
      SELECT series_key, number, trim(notes) AS notes, min((pr, record_id)) AS first_at FROM {_RECORDS} WHERE trim(notes) <> '' GROUP BY ALL)
    GROUP BY series_key, number""")
def joined_notes(spark: SparkSession, d: str) -> DataFrame:
    """The different notes of each numbered disc in order of trust."""
    return R.joined_distinct(_records(spark, d), ["series_key", "number"], "notes", ["pr", "record_id"])


@query(f"""
    SELECT series_key, number, year, month, day FROM (
      SELECT *, row_number() OVER (PARTITION BY series_key, number ORDER BY -((year IS NOT NULL)::INT + (month IS NOT NULL)::INT + (day IS NOT NULL)::INT), pr, record_id) AS k FROM (
        SELECT series_key, number, pr, record_id, y AS year, m AS month, CASE WHEN m IS NOT NULL AND try_cast(ds AS INTEGER) BETWEEN 1 AND 31 THEN try_cast(ds AS INTEGER) END AS day FROM (
          SELECT *, CASE WHEN try_cast(ys AS INTEGER) BETWEEN 1950 AND 2100 THEN try_cast(ys AS INTEGER) END AS y,
                 CASE WHEN try_cast(ys AS INTEGER) BETWEEN 1950 AND 2100 AND try_cast(ms AS INTEGER) BETWEEN 1 AND 12 THEN try_cast(ms AS INTEGER) END AS m FROM (
            SELECT *, regexp_extract(date_text, '^(\\d{{4}})(?:-|$)', 1) AS ys, regexp_extract(date_text, '^\\d{{4}}-(\\d\\d)', 1) AS ms, regexp_extract(date_text, '^\\d{{4}}-\\d\\d-(\\d\\d)', 1) AS ds FROM {_RECORDS})))
      WHERE year IS NOT NULL) WHERE k = 1""")
def best_partial_dates(spark: SparkSession, d: str) -> DataFrame:
    """The most exact date of each numbered disc."""
    out = R.most_precise_date(_records(spark, d), ["series_key", "number"], ["date_text"], ["pr", "record_id"])
    return out.select("series_key", "number", "date.*")


@query(f"""
    SELECT series_key, number, source, record_id, title FROM (
      SELECT *, min(pr) OVER (PARTITION BY series_key, number) AS best, row_number() OVER (PARTITION BY series_key, number, pr, lower(title) ORDER BY record_id) AS k FROM {_RECORDS})
    WHERE pr = best AND k = 1""")
def best_source_titles(spark: SparkSession, d: str) -> DataFrame:
    """The different titles of the most trusted source of each numbered disc."""
    rows = _records(spark, d).withColumn("_low", F.lower("title"))
    return R.best_source_rows(rows, ["series_key", "number"], "pr", ["_low"], ["record_id"]).select("series_key", "number", "source", "record_id", "title")


@query(f"""
    SELECT spelling, publisher, n FROM (
      SELECT *, row_number() OVER (PARTITION BY spelling ORDER BY n DESC, publisher) AS k FROM (
        SELECT replace({T.normalise('publisher')}, ' ', '') AS spelling, publisher, count(*) AS n FROM content_records GROUP BY ALL) WHERE spelling <> '') WHERE k = 1""")
def common_spellings(spark: SparkSession, d: str) -> DataFrame:
    """The most common way in which each publisher's name is written; case, accents, signs and blanks make no difference."""
    rows = table(spark, d, "content_records").select(F.replace(N.normalise(F.col("publisher")), F.lit(" "), F.lit("")).alias("spelling"), "publisher").where("spelling <> ''")
    return R.vote(rows, ["spelling"], "publisher")


@query("""
    SELECT series_id, publisher, w, total FROM (
      SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY w DESC, publisher) AS k, sum(w) OVER (PARTITION BY series_id)::BIGINT AS total FROM (
        SELECT series_id, publisher, count(*) AS w FROM disks WHERE series_id <> '' AND publisher <> '' GROUP BY ALL)) WHERE k = 1 AND w >= 2 AND w >= 0.2 * total""")
def dominant_publishers(spark: SparkSession, d: str) -> DataFrame:
    """The publisher with a fifth of a series' discs, and two of them at least."""
    rows = table(spark, d, "disks").where("series_id <> '' AND publisher <> ''").withColumn("one", F.lit(1))
    return R.dominant(rows, ["series_id"], "publisher", "one", least_share=0.2, least=2)


@query("SELECT title, min(id) AS id FROM disks WHERE title <> '' GROUP BY title HAVING count(DISTINCT id) = 1")
def titles_of_one_disc(spark: SparkSession, d: str) -> DataFrame:
    """Titles that exactly one disc has."""
    return R.sole_owner(table(spark, d, "disks"), "title", "id")


@query("""
    SELECT record_id, category FROM (
      SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY t, n DESC, list_position(['Games', 'Applications', 'Demos', 'Music'], category)) AS k FROM (
        SELECT record_id, CASE WHEN kind IN ('game', 'tool', 'demo') THEN 0 ELSE 1 END AS t,
               CASE kind WHEN 'game' THEN 'Games' WHEN 'tool' THEN 'Applications' WHEN 'demo' THEN 'Demos' WHEN 'doc' THEN 'Games' END AS category, count(*) AS n
        FROM (SELECT DISTINCT * FROM content_records) WHERE kind IN ('game', 'tool', 'demo', 'doc') GROUP BY ALL)) WHERE k = 1""")
def majority_categories(spark: SparkSession, d: str) -> DataFrame:
    """What each record's titles mostly are; documents decide only where nothing else is."""
    rows = table(spark, d, "content_records").dropDuplicates()
    return R.majority(rows, ["record_id"], "kind", {"game": "Games", "tool": "Applications", "demo": "Demos"}, {"doc": "Games"}, ["Games", "Applications", "Demos", "Music"])


# Lookups


_ATTEMPTS = ((({"md5": "md5"}), "md5"), (({"crc32": "crc32", "size_bytes": "size_bytes"}), "crc32 and size"), (({"raw_crc32": "crc32", "size_bytes": "size_bytes"}), "raw crc32 and size"))


@query("""
    WITH t AS (SELECT id, lower(md5) AS md5, lower(crc32) AS crc32, size_bytes, bad, rank_no FROM images),
    p AS (SELECT DISTINCT id, lower(md5) AS md5, lower(crc32) AS crc32, lower(raw_crc32) AS raw_crc32, size_bytes FROM library_files),
    h AS (
      SELECT p.id, 0 AS i, 'md5' AS attempt, t.* EXCLUDE (id), t.id AS image_id FROM p JOIN t ON p.md5 = t.md5 AND p.md5 <> ''
      UNION ALL SELECT p.id, 1, 'crc32 and size', t.* EXCLUDE (id), t.id FROM p JOIN t ON p.crc32 = t.crc32 AND p.size_bytes = t.size_bytes AND p.crc32 <> ''
      UNION ALL SELECT p.id, 2, 'raw crc32 and size', t.* EXCLUDE (id), t.id FROM p JOIN t ON p.raw_crc32 = t.crc32 AND p.size_bytes = t.size_bytes AND p.raw_crc32 <> '')
    SELECT id, image_id, attempt FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i, bad NULLS FIRST, rank_no NULLS FIRST, image_id) AS k FROM h) WHERE k = 1""")
def match_files_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """The known dump of each file by the first hash that finds one, good dumps before bad ones."""
    files = table(spark, d, "library_files").select("id", "md5", "crc32", "raw_crc32", "size_bytes").dropDuplicates()
    images = table(spark, d, "images").withColumnRenamed("id", "image_id")
    return R.match_in_order(files, "id", images, _ATTEMPTS, ["bad", "rank_no"], "image_id")


@query("""
    SELECT record_id, batch_id, nearest_batch_id FROM (
      SELECT r.record_id, r.batch_id, b.batch_id AS nearest_batch_id,
             row_number() OVER (PARTITION BY r.record_id, r.batch_id, r.received_at ORDER BY abs(epoch_us(r.received_at) - epoch_us(b.retrieved)), b.retrieved, b.batch_id) AS k
      FROM (SELECT DISTINCT record_id, batch_id, source, received_at FROM disk_records) r JOIN source_batches b ON b.source = r.source AND b.retrieved IS NOT NULL) WHERE k = 1""")
def nearest_batches(spark: SparkSession, d: str) -> DataFrame:
    """The delivery of its source nearest to each record in time."""
    probes = table(spark, d, "disk_records").select("record_id", "batch_id", "source", "received_at").dropDuplicates()
    targets = table(spark, d, "source_batches").select("source", "batch_id", "retrieved")
    return R.nearest_in_time(probes, targets, ["source"], "received_at", "retrieved", ["batch_id"]).select("record_id", "batch_id", "nearest_batch_id")


_RULES = (("^the .* of ", "quest"), ("(racer|rally|circuit)", "racing"), ("(puzzle|pinball)", "puzzle"), ("\\\\b(ii|iii|iv|v)$", "sequel"))


@query("""
    SELECT DISTINCT record_id, title, CASE WHEN regexp_matches(title, '^the .* of ', 'i') THEN 'quest' WHEN regexp_matches(title, '(racer|rally|circuit)', 'i') THEN 'racing'
           WHEN regexp_matches(title, '(puzzle|pinball)', 'i') THEN 'puzzle' WHEN regexp_matches(title, '(^|[^\\pL\\pN_])(ii|iii|iv|v)$', 'i') THEN 'sequel' ELSE '' END AS rule
    FROM disk_records""")
def first_rule_of_titles(spark: SparkSession, d: str) -> DataFrame:
    """The first of several ordered rules that each title fits; '' for none, also of a NULL title."""
    rows = table(spark, d, "disk_records")
    rules = [(p.replace("\\\\", "\\"), label) for p, label in _RULES]
    return rows.select("record_id", "title", R.rule_join(rows, "title", rules).alias("rule")).distinct()


@query(f"""
    SELECT DISTINCT a.alias_id, coalesce(s.id, '') AS series_id FROM series_alias a
    LEFT JOIN (SELECT {T.ascii_words('name')} AS key, platform, min(id) AS id FROM series_defs GROUP BY ALL) s ON s.key = {T.ascii_words('a.alias')} AND s.platform = a.platform""")
def lookup_series_names(spark: SparkSession, d: str) -> DataFrame:
    """Typed series names found by their comparison form on their platform; '' for none, also of a NULL alias."""
    listed = table(spark, d, "series_defs").select(N.ascii_words(F.col("name")).alias("key"), "platform", F.lit(0).alias("ord"), "id")
    return R.name_lookup(table(spark, d, "series_alias"), "alias", "platform", listed).select("alias_id", F.coalesce("series_id", F.lit("")).alias("series_id")).distinct()


@query(f"""
    WITH p AS (SELECT DISTINCT title_id AS g, content_id AS probe_id, title FROM content_records WHERE title_id IS NOT NULL AND trim(title) <> ''),
    t AS (SELECT g, min(probe_id) AS title_id, arg_min(title, (probe_id, title)) AS title FROM p GROUP BY g),
    k AS (SELECT *, 1 AS way, {T.title_key('title')} AS k1, {T.normalise(f"({T.display_title('title')})")} AS k2, {T.normalise('title')} AS k3, {T.title_words('title')} AS w FROM (
      SELECT g, probe_id AS id, 'p' AS side, title FROM p UNION ALL SELECT g, title_id, 't', title FROM t)),
    l AS (SELECT DISTINCT g, id, side, unnest([k1, k2, k3]) AS k FROM k),
    e AS (SELECT a.id AS probe_id, min(b.id) AS title_id FROM l a JOIN l b ON a.g = b.g AND a.k = b.k AND a.side = 'p' AND b.side = 't' WHERE a.k <> '' GROUP BY a.id),
    s AS (SELECT a.id AS probe_id, b.id AS title_id, len(list_intersect(a.w, b.w)) AS c, len(a.w) AS n, len(b.w) AS m
          FROM k a JOIN k b ON a.g = b.g AND a.side = 'p' AND b.side = 't' WHERE a.id NOT IN (SELECT probe_id FROM e)),
    b AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY c / least(n, m) DESC, c / (n + m - c) DESC, title_id) AS r FROM s WHERE c > 0)
    SELECT probe_id, title_id, 'exact' AS how FROM e
    UNION ALL SELECT probe_id, title_id, 'words' FROM b WHERE r = 1 AND c / least(n, m) >= 0.75 AND c / (n + m - c) >= 0.4""")
def fuzzy_title_matches(spark: SparkSession, d: str) -> DataFrame:
    """The sources' spellings of each title that stand for its first spelling."""
    probes = table(spark, d, "content_records").where("title_id IS NOT NULL AND trim(title) <> ''").select(F.col("title_id").alias("g"), F.col("content_id").alias("probe_id"), "title").distinct()
    titles = probes.groupBy("g").agg(F.min("probe_id").alias("title_id"), F.min(F.struct("probe_id", "title"))["title"].alias("title")).withColumn("ord", F.col("title_id"))
    return R.fuzzy_titles(probes, titles, "g")


@query("""
    WITH u AS (SELECT DISTINCT path AS address FROM library_files WHERE path IS NOT NULL),
    c AS (SELECT address, substr(address, 1, i) AS prefix FROM (SELECT address, unnest(range(1, length(address) + 1)) AS i FROM u) WHERE substr(address, i, 1) = '/'),
    n AS (SELECT prefix FROM c GROUP BY prefix HAVING count(*) >= 50)
    SELECT u.address, coalesce(max_by(c.prefix, length(c.prefix)) FILTER (n.prefix IS NOT NULL), '') AS prefix,
           substr(u.address, length(coalesce(max_by(c.prefix, length(c.prefix)) FILTER (n.prefix IS NOT NULL), '')) + 1) AS rest
    FROM u LEFT JOIN c USING (address) LEFT JOIN n USING (prefix) GROUP BY u.address""")
def shared_path_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """File paths parted at the longest beginning that fifty of them share."""
    return R.shared_prefixes(table(spark, d, "library_files"), "path", 50)


# Windows


@query("""
    SELECT series_id, min(number) AS first, max(number) AS last, count(*) AS n FROM (
      SELECT series_id, number, number - row_number() OVER (PARTITION BY series_id ORDER BY number) AS g FROM (SELECT DISTINCT series_id, number FROM disks WHERE series_id <> '' AND number IS NOT NULL))
    GROUP BY series_id, g""")
def runs_of_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive numbers of each series."""
    return R.islands(table(spark, d, "disks").where("series_id <> ''"), ["series_id"], "number")


@query("SELECT pair_id, last_value(score IGNORE NULLS) OVER (PARTITION BY left_kind, left_id ORDER BY judged_at, pair_id) AS score FROM (SELECT DISTINCT * FROM match_pairs)")
def scores_filled_forward(spark: SparkSession, d: str) -> DataFrame:
    """Absent scores taken from the last verdict before on the same thing."""
    rows = table(spark, d, "match_pairs").dropDuplicates()
    return R.fill_forward(rows, ["left_kind", "left_id"], ["judged_at", "pair_id"], ["score"]).select("pair_id", "score")


@query("SELECT id, disk_id, row_number() OVER (PARTITION BY disk_id ORDER BY bad NULLS FIRST, rank_no NULLS FIRST, id) - 1 AS rank FROM images WHERE disk_id IS NOT NULL")
def dump_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Each dump's rank on its disc, best first, from 0."""
    return R.ranked_in(table(spark, d, "images").where("disk_id IS NOT NULL"), ["disk_id"], ["bad", "rank_no", "id"], start=0).select("id", "disk_id", F.col("rank").cast("long"))


@query("SELECT id, title, row_number() OVER (PARTITION BY series_id, title ORDER BY number, id) AS occurrence FROM disks WHERE title <> ''")
def occurrence_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Which disc of its title within the series each is."""
    return R.ranked_in(table(spark, d, "disks").where("title <> ''"), ["series_id", "title"], ["number", "id"], "occurrence").select("id", "title", F.col("occurrence").cast("long"))


@query("""
    SELECT series_id, title, place FROM (
      SELECT series_id, title, row_number() OVER (PARTITION BY series_id ORDER BY first_at, title) AS place FROM (
        SELECT series_id, title, min((number IS NOT NULL, number, id)) AS first_at FROM disks WHERE series_id <> '' AND title <> '' GROUP BY ALL)) WHERE place <= 8""")
def first_titles_of_series(spark: SparkSession, d: str) -> DataFrame:
    """The first eight different titles of each series in disc order, as a result row reports them."""
    rows = table(spark, d, "disks").where("series_id <> '' AND title <> ''")
    return R.first_n_distinct(rows, ["series_id"], "title", ["number", "id"], 8).select("series_id", "title", F.col("place").cast("long"))


# Orders and pages


@query("SELECT id, label, release_year FROM disks ORDER BY release_year DESC NULLS LAST, label, id LIMIT 100 OFFSET 100")
def page_by_year(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a hundred, newest first, those without a year last."""
    return table(spark, d, "disks").select("id", "label", "release_year").orderBy(F.col("release_year").desc_nulls_last(), "label", "id").offset(100).limit(100)


@query("SELECT id, publisher FROM disks ORDER BY translate(publisher, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), publisher, id LIMIT 100")
def page_by_name_without_case(spark: SparkSession, d: str) -> DataFrame:
    """A page in an order in which the case of A to Z counts last."""
    from diskloom.plans.find import nocase

    return table(spark, d, "disks").select("id", "publisher").orderBy(nocase(F.col("publisher")), "publisher", "id").limit(100)


@query(f"SELECT id, title, {T.sort_key('title')} AS key FROM disks")
def natural_sort_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key by which titles sort as people count; NULL for a NULL title."""
    return table(spark, d, "disks").select("id", "title", N.sort_key(F.col("title")).alias("key"))


# Tables that change


_SNAP = "SELECT id, label, platform FROM disks WHERE added_at <= TIMESTAMP '{0}' AND (removed_at IS NULL OR removed_at > TIMESTAMP '{0}')"


@query(f"""
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'gone' WHEN a.label IS NOT DISTINCT FROM b.label AND a.platform = b.platform THEN 'unchanged' ELSE 'changed' END AS change
    FROM ({_SNAP.format('2022-01-01')}) a FULL JOIN ({_SNAP.format('2024-01-01')}) b ON a.id = b.id""")
def changes_between_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """What became of each disc between two dates."""
    rows = table(spark, d, "disks")
    at = lambda t: rows.where((F.col("added_at") <= F.lit(t).cast("timestamp")) & (F.col("removed_at").isNull() | (F.col("removed_at") > F.lit(t).cast("timestamp"))))
    return R.snapshot_diff(at("2022-01-01"), at("2024-01-01"), "id", ["label", "platform"])


@query("""
    SELECT id, path, recorded_at FROM (SELECT *, row_number() OVER (PARTITION BY path, member_path ORDER BY recorded_at DESC, id DESC) AS k FROM library_files) WHERE k = 1""")
def latest_file_records(spark: SparkSession, d: str) -> DataFrame:
    """The last record of each file and member."""
    return R.latest_rows(table(spark, d, "library_files"), ["path", "member_path"], [F.col("recorded_at").desc(), F.col("id").desc()]).select("id", "path", "recorded_at")


@query("""
    SELECT id, label, publisher FROM disks WHERE id NOT IN (SELECT disk_id FROM images WHERE bad AND disk_id IS NOT NULL)
    UNION ALL SELECT d.id, 'damaged: ' || d.label, d.publisher FROM disks d WHERE d.id IN (SELECT disk_id FROM images WHERE bad)""")
def upsert_damaged_labels(spark: SparkSession, d: str) -> DataFrame:
    """Discs with new rows in place of those that have a bad dump."""
    rows = table(spark, d, "disks").select("id", "label", "publisher")
    bad = table(spark, d, "images").where("bad AND disk_id IS NOT NULL").select(F.col("disk_id").alias("id")).distinct()
    new = rows.join(bad, "id", "left_semi").withColumn("label", F.concat(F.lit("damaged: "), "label"))
    return R.upsert(rows, new, ["id"])


# Texts


@query("SELECT md5(text) AS digest, min(doc_id) AS first_id, count(DISTINCT doc_id) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def copies_by_digest(spark: SparkSession, d: str) -> DataFrame:
    """Documents grouped by the hash of their text."""
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first_id"), F.countDistinct("doc_id").alias("n"))


@query("SELECT doc_id, lower(regexp_extract(text, 'https?://([^/:?#\\s]+)', 1)) AS host FROM documents WHERE regexp_matches(text, 'https?://')")
def first_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The host of the first address in each text."""
    return table(spark, d, "documents").where(F.col("text").rlike("https?://")).select("doc_id", F.lower(F.regexp_extract("text", r"https?://([^/:?#\s]+)", 1)).alias("host"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def json_sums(spark: SparkSession, d: str) -> DataFrame:
    """A field of JSON texts summed by event type."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.from_json("props", "k bigint")["k"]).alias("total"))


@query("""
    SELECT DISTINCT image_record_id, lower(regexp_extract(name, '([^/\\\\]*)$', 1)) AS base,
           CASE WHEN position('.' IN regexp_extract(name, '([^/\\\\]*)$', 1)) > 0 THEN regexp_extract(lower(regexp_extract(name, '([^/\\\\]*)$', 1)), '^(.*)\\.[^.]*$', 1) ELSE lower(regexp_extract(name, '([^/\\\\]*)$', 1)) END AS stem
    FROM image_records WHERE name <> ''""")
def image_file_keys(spark: SparkSession, d: str) -> DataFrame:
    """The names by which image files are joined, of all that have one."""
    rows = table(spark, d, "image_records").where("name <> ''")
    keys = N.image_name_keys(F.col("name"))
    return rows.select("image_record_id", keys[0].alias("base"), F.coalesce(F.get(keys, F.lit(1)), keys[0]).alias("stem")).distinct()


QUERIES = Q
