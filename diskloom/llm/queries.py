"""Queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.llm.canon import map_aliases
from diskloom.llm.components import verdict_groups
from diskloom.llm.crossmatch import cross_source_pairs, unseried_discs
from diskloom.llm.encode import encode_corpus
from diskloom.llm.leakage import leaked_items, without_leaks
from diskloom.llm.names import variant_pairs
from diskloom.llm.spam import stuffed_pages, stuffing_scores
from diskloom.llm.survivor import surviving_contents
from diskloom.functions.text import STAND_INS
from diskloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every linked disc and image with the key of its whole group."""
    return verdict_groups(table(spark, d, "match_pairs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every two spellings of one crew among the names of crews and the crackers of titles."""
    crews, contents = table(spark, d, "crew_records"), table(spark, d, "content_records")
    values = crews.select(F.col("name").alias("value")).union(contents.select("cracker"))
    return variant_pairs(values, crews.select(F.col("name").alias("value"), "members"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows whose publisher and cracker survive for each title."""
    return surviving_contents(table(spark, d, "content_records"), table(spark, d, "source_batches"))


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    """Records of one disc from different sources, with the confidence of each match."""
    return cross_source_pairs(unseried_discs(table(spark, d, "disk_records"), table(spark, d, "content_records"), table(spark, d, "image_records")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs alone."""
    return p5_matches(spark, d).select("record_a", "record_b")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The series that every typed alias means, or ''."""
    return map_aliases(table(spark, d, "series_alias"), table(spark, d, "series_defs"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, d, "documents"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an evaluation item, with the share of its words."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs alone."""
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that may stay in the training text."""
    return without_leaks(table(spark, d, "documents"), p8_leaks(spark, d)).select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document is stuffing."""
    return stuffing_scores(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are made for search engines."""
    return stuffed_pages(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_matches": p5_matches, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p8_leaks": p8_leaks, "p8_clean": p8_clean, "p9_found": p9_found, "p9_scores": p9_scores}

_NOTHING = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(STAND_INS))

SQL = {
    "p4_found": f"""
        WITH c AS (
          SELECT c.title_id, c.content_id, c.publisher, c.cracker, coalesce(b.priority, 90) AS priority, b.retrieved
          FROM content_records c LEFT JOIN source_batches b USING (batch_id) WHERE c.title_id IS NOT NULL),
        l AS (
          SELECT title_id, content_id, priority, retrieved, 'publisher' AS field, publisher AS value FROM c
          UNION ALL SELECT title_id, content_id, priority, retrieved, 'cracker', cracker FROM c),
        v AS (
          SELECT * FROM l WHERE regexp_matches(value, '[\\p{{L}}\\p{{N}}]') AND NOT contains(value, chr(65533))
            AND NOT regexp_matches(value, '(…|\\.\\.\\.)\\s*$')
            AND lower(trim(value)) NOT IN ({_NOTHING})),
        k AS (
          SELECT title_id, field, content_id,
                 row_number() OVER (PARTITION BY title_id, field ORDER BY priority, retrieved DESC NULLS LAST, content_id) AS k
          FROM v WHERE title_id IN (SELECT title_id FROM c GROUP BY title_id HAVING count(DISTINCT content_id) > 1))
        SELECT title_id, field, content_id FROM k WHERE k = 1
    """,
    "p1_found": """
        WITH RECURSIVE v AS (
          SELECT CASE WHEN lower(trim(left_kind)) = 'disk' THEN left_id ELSE left_id + 1000000000000 END AS l,
                 CASE WHEN lower(trim(right_kind)) = 'disk' THEN right_id ELSE right_id + 1000000000000 END AS r,
                 lower(trim(verdict)) AS verdict, judged_at, pair_id
          FROM match_pairs WHERE left_id IS NOT NULL AND right_id IS NOT NULL),
        s AS (
          SELECT a, b FROM (
            SELECT least(l, r) AS a, greatest(l, r) AS b, verdict,
                   row_number() OVER (PARTITION BY least(l, r), greatest(l, r) ORDER BY judged_at DESC NULLS LAST, pair_id DESC) AS k
            FROM v WHERE l <> r) WHERE k = 1 AND verdict = 'same'),
        e AS (SELECT a, b FROM s UNION SELECT b, a FROM s),
        reach AS (SELECT a AS node, a AS lo FROM e UNION SELECT e.b, reach.lo FROM reach JOIN e ON e.a = reach.node WHERE reach.lo < e.b),
        g AS (SELECT node, min(lo) AS lo FROM reach GROUP BY node)
        SELECT CASE WHEN node >= 1000000000000 THEN 'image' ELSE 'disk' END AS node_kind, node % 1000000000000 AS node_id,
               CASE WHEN lo >= 1000000000000 THEN 'image:' ELSE 'disk:' END || (lo % 1000000000000) AS group_key
        FROM g
    """,
}
