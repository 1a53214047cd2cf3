"""Queries of the text index over documents and disc names, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.operators import textindex as X
from diskloom.session import cut, table

Q = {}
SQL = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def _plain(c: str):
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def _documents(spark: SparkSession, d: str) -> X.TextIndex:
    rows = table(spark, d, "documents").select("doc_id", _plain("text").alias("text"), _plain("site").alias("site"))
    return X.text_index(rows, "doc_id", {"text": 1.0, "site": 5.0}, cut(X.build_postings(rows, "doc_id", ["text", "site"])))  # written once, scanned by each step of the ranking


_POSTINGS = """
    WITH t AS (
      SELECT doc_id AS id, 'text' AS field, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS token FROM documents
      UNION ALL SELECT doc_id, 'site', unnest(regexp_extract_all(lower(coalesce(site, '')), '[a-z0-9]+')) FROM documents),
    l AS (SELECT id, count(*) AS len FROM t GROUP BY id),
    g AS (SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) FROM t) / (SELECT count(*) FROM documents) AS avgdl),
    p AS (SELECT id, field, token, count(*) AS tf FROM t GROUP BY ALL)
"""


def _bm25(conditions: dict[str, str], fields: str = "'text', 'site'") -> str:
    """SQL of each phrase's frequency by row (f0, f1, ...) under its condition on a token."""
    sums = ", ".join(f"sum(CASE WHEN {c} THEN tf * CASE field WHEN 'site' THEN 5.0 ELSE 1.0 END ELSE 0 END) AS {f}" for f, c in conditions.items())
    return f"f AS (SELECT id, {sums} FROM p WHERE field IN ({fields}) GROUP BY id)"


def _score(f: str) -> str:
    n = f"(SELECT count(*) FROM f WHERE {f} > 0)"
    idf = f"ln((n_rows - {n} + 0.5) / ({n} + 0.5))"
    return f"CASE WHEN {idf} > 0 THEN {idf} ELSE 1e-6 END * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * len / avgdl))"


@query(_POSTINGS + ", " + _bm25({"f0": "token LIKE 'disc%'", "f1": "token LIKE 'party%'"}) + " SELECT id AS doc_id FROM f WHERE f0 > 0 AND f1 > 0")
def text_all_words(spark: SparkSession, d: str) -> DataFrame:
    """Documents with both words, each as the start of a token."""
    return X.matched_ids(_documents(spark, d), X.word_query(["disc", "party"])).select(F.col("id").alias("doc_id"))


@query(_POSTINGS + ", " + _bm25({"f0": "token LIKE 'disc%'", "f1": "token LIKE 'party%'"}) + f"""
    SELECT id AS doc_id, round(-({_score('f0')} + {_score('f1')}), 6) AS rank FROM f JOIN l USING (id), g WHERE f0 > 0 AND f1 > 0""")
def text_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The same ranked by bm25 over two weighted fields."""
    return X.ranked(_documents(spark, d), X.word_query(["disc", "party"])).select(F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"))


@query(_POSTINGS + ", " + _bm25({"f0": "token LIKE 'disc%'", "f1": "token LIKE 'party%'"}) + f"""
    SELECT id AS doc_id, round(-({_score('f0')} + {_score('f1')}), 6) AS rank FROM f JOIN l USING (id), g WHERE f0 > 0 AND f1 > 0 ORDER BY 2, 1 LIMIT 20""")
def text_top_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of twenty of that ranking, ties by id."""
    rows = X.ranked(_documents(spark, d), X.word_query(["disc", "party"])).select(F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"))
    return rows.orderBy("rank", "doc_id").limit(20)


@query(_POSTINGS + ", " + _bm25({"f0": "token LIKE 'amiga500%'", "f1": "token LIKE 'amiga%'", "f2": "token = '500'"}) + f"""
    SELECT id AS doc_id, round(-({_score('f0')} + CASE WHEN f1 > 0 AND f2 > 0 THEN {_score('f1')} + {_score('f2')} ELSE 0 END), 6) AS rank
    FROM f JOIN l USING (id), g WHERE f0 > 0 OR (f1 > 0 AND f2 > 0)""")
def text_compound_word(spark: SparkSession, d: str) -> DataFrame:
    """A word with a number in it, whole or as its parts; only the branch that holds scores."""
    return X.ranked(_documents(spark, d), X.word_query(["amiga500"])).select(F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"))


@query(_POSTINGS + ", " + _bm25({"f0": "token LIKE 'menus%'"}, "'site'") + f" SELECT id AS doc_id, round(-({_score('f0')}), 6) AS rank FROM f JOIN l USING (id), g WHERE f0 > 0")
def text_in_one_field(spark: SparkSession, d: str) -> DataFrame:
    """A word looked for in one field only: frequency and rarity count that field, the length all."""
    return X.ranked(_documents(spark, d), X.word_query(["menus"]), ["site"]).select(F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"))


@query("SELECT id, label FROM disks WHERE contains(lower(label), 'ik') AND contains(lower(label), 'ud')")
def text_inside_names(spark: SparkSession, d: str) -> DataFrame:
    """Words anywhere inside a name, as the search falls back to."""
    return table(spark, d, "disks").where(F.lower("label").contains("ik") & F.lower("label").contains("ud")).select("id", "label")


QUERIES = Q
