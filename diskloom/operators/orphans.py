"""References to records that do not exist: orphan foreign keys, with the cause, per table and period."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diskloom.session import cut

#: A reference key with at least this many rows is never sent to one task, whether it holds or not.
HOT_ROWS = 100_000
#: At most this many keys, those with the most rows, are broadcast; the rest of them are shuffled like any other.
MOST_HOT = 1000


def orphan_references(
    child: DataFrame,
    parents: dict[str, tuple[str, DataFrame]],
    *,
    child_id: str = "id",
    seen: str = "last_seen",
    parent_id: str = "id",
    added: str = "added_at",
    removed: str = "removed_at",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each non-NULL reference of ``child`` that did not hold when the child row was seen.

    ``parents`` maps a reference table's name to (foreign-key column of ``child``, parent frame). Result columns:
    ``file_id, ref_table, period, cause``; cause is ``missing`` (no such key), ``late`` (the parent was added after the
    child was seen) or ``deleted`` (it was removed at or before that). Each result row appears once, so repeated child
    rows count once.

    The plan: all references of a child row are read in one pass. The child's distinct keys come with their row count
    and their first and last sighting (combined before the shuffle) and are held against the parents by key. Keys
    without a parent (the anti-join) and keys whose parent's life does not cover all sightings are the suspects. These
    and the hot keys, suspects or not, are written once; then the child is read a second time and joined back. Rows of
    a hot key (``hot_rows`` rows or more, at most MOST_HOT keys) meet a broadcast, so none of them is sent to the task
    of its key; all others are shuffled, or meet a broadcast where the suspects are few.

    NULL keys refer to nothing and give no row. A NULL ``seen`` can break no time rule: such a row is only ever
    ``missing``, with a NULL period. A parent with a NULL ``added`` counts as always there. Parents listed more than
    once count from the first ``added`` to the last ``removed`` (still there if any row is). Empty tables give an
    empty result; other columns are ignored.
    """
    references = F.array(*(F.struct(F.lit(name).alias("ref_table"), F.col(fk).cast("long").alias("key")) for name, (fk, _) in parents.items()))
    refers = reduce(lambda a, b: a | b, (F.col(fk).isNotNull() for fk, _ in parents.values()))
    rows = child.where(refers).select(F.col(child_id).alias("file_id"), F.col(seen).alias("seen"), F.explode(references).alias("r")).select("file_id", "seen", "r.*").where("key IS NOT NULL")
    keys = rows.groupBy("ref_table", "key").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
    lives = reduce(
        DataFrame.unionByName,
        (p.select(F.lit(name).alias("ref_table"), F.col(parent_id).cast("long").alias("key"), F.col(added).alias("added"), F.col(removed).alias("removed")) for name, (_, p) in parents.items()),
    )
    alive = lives.where("key IS NOT NULL").groupBy("ref_table", "key").agg(
        F.when(F.count(F.lit(1)) == F.count("added"), F.min("added")).alias("added"),
        F.when(F.count(F.lit(1)) == F.count("removed"), F.max("removed")).alias("removed"),
        F.lit(True).alias("known"),
    )
    suspect = F.col("known").isNull() | F.coalesce(F.col("added") > F.col("first_seen"), F.lit(False)) | F.coalesce(F.col("removed") <= F.col("last_seen"), F.lit(False))
    held = keys.join(alive, ["ref_table", "key"], "left").withColumn("suspect", suspect).where(F.col("suspect") | (F.col("n") >= hot_rows))
    held = cut(held.select("ref_table", "key", "n", "known", "added", "removed", "suspect"))
    hot = held.where(F.col("n") >= hot_rows).orderBy(F.col("n").desc(), "ref_table", "key").limit(MOST_HOT)
    hot = hot.select("ref_table", "key", F.struct("known", "added", "removed", "suspect").alias("h"))
    cold = held.where("suspect").join(F.broadcast(hot.select("ref_table", "key")), ["ref_table", "key"], "left_anti")
    cold = cold.select(F.col("ref_table").alias("_t"), F.col("key").alias("_k"), F.struct("known", "added", "removed", "suspect").alias("c"), F.lit(False).alias("_hot"))
    met = rows.join(F.broadcast(hot), ["ref_table", "key"], "left").withColumn("hot", F.col("h").isNotNull())
    spread = F.when(F.col("hot"), F.xxhash64("file_id", "seen")).otherwise(F.col("key"))  # rows that are settled go anywhere
    both = met.withColumn("_spread", spread).join(cold, (F.col("_spread") == F.col("_k")) & (F.col("hot") == F.col("_hot")) & (F.col("ref_table") == F.col("_t")), "left")
    bad = both.select("file_id", "ref_table", "seen", F.coalesce("h", "c").alias("x")).where("x.suspect").select("file_id", "ref_table", "seen", "x.*")
    cause = F.when(F.col("known").isNull(), "missing").when(F.col("added") > F.col("seen"), "late").when(F.col("removed") <= F.col("seen"), "deleted")
    return bad.select("file_id", "ref_table", F.date_format("seen", "yyyy-MM").alias("period"), cause.alias("cause")).where("cause IS NOT NULL").dropDuplicates()


def orphan_report(references: DataFrame) -> DataFrame:
    """Orphan references counted per referenced table, period and cause."""
    return references.groupBy("ref_table", "period", "cause").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("file_id").alias("n_files"))
