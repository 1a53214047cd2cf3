"""Joins, aggregates and window operators of the catalogue, each a composition of DataFrame operations.

Text columns use '' for absent, so "first non-empty" and "count present" mean the same for '' and NULL. All orders
that pick a row end in a unique key, so results do not depend on how rows are spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diskloom.functions import names as N
from diskloom.operators.skew import lookup_join
from diskloom.session import cut


def present(c: Column) -> Column:
    """The value, NULL for ''."""
    return F.nullif(c, F.lit(""))


# Merging values of several sources


def first_present(rows: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """For each key and column the first non-empty value in ``order``; '' where no row has one. Map-side combined."""
    by = F.struct(*order)
    return rows.groupBy(*keys).agg(*(F.coalesce(F.min(F.when(present(F.col(v)).isNotNull(), F.struct(by.alias("at"), F.col(v).alias("v"))))["v"], F.lit("")).alias(v) for v in values))


def joined_distinct(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], separator: str = "\n") -> DataFrame:
    """For each key the different non-empty values in order of first appearance, joined.

    Values are made distinct before they are gathered, so a key of many rows gathers only its different values.
    """
    firsts = rows.where(F.trim(F.col(value)) != "").groupBy(*keys, F.trim(F.col(value)).alias("_v")).agg(F.min(F.struct(*order)).alias("_at"))
    listed = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_l"))
    return listed.select(*keys, F.array_join(F.transform("_l", lambda x: x["_v"]), separator).alias(value))


def best_source_rows(rows: DataFrame, keys: Sequence[str], priority: str, identity: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of the source with the best priority of each key, one for each ``identity``, the first in ``order``."""
    best = rows.groupBy(*keys).agg(F.min(priority).alias("_best"))
    kept = rows.join(best, list(keys)).where(F.col(priority) == F.col("_best")).drop("_best")
    w = Window.partitionBy(*keys, *identity).orderBy(*order)
    return kept.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def most_precise_date(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """For each key the most exact date text: of the first of ``columns`` that has any, the most precise, then the first in ``order``."""
    options = F.array(*(F.struct(F.lit(i).alias("rank"), N.parse_date(F.col(c)).alias("date")) for i, c in enumerate(columns)))
    long = rows.select(*keys, *order, F.explode(options).alias("o")).withColumn("exact", N.precision(F.col("o.date"))).where("exact > 0")
    return long.groupBy(*keys).agg(F.min(F.struct(F.col("o.rank"), -F.col("exact"), *order, F.col("o.date").alias("date")))["date"].alias("date"))


def vote(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most common value of each key, of equally common ones the smallest; with how often it occurs."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("_b")).select(*keys, F.col("_b.v").alias(value), (-F.col("_b.m")).alias("n"))


def dominant(rows: DataFrame, keys: Sequence[str], choice: str, weight: str, *, least_share: float = 0.9, least: int = 10) -> DataFrame:
    """The choice of each key that holds ``least_share`` of its weight and ``least`` of it; ties go to the smallest; keys without one have no row."""
    sums = rows.groupBy(*keys, choice).agg(F.sum(weight).alias("w"))
    best = sums.groupBy(*keys).agg(F.min(F.struct((-F.col("w")).alias("m"), F.col(choice).alias("c"))).alias("_b"), F.sum("w").alias("total"))
    out = best.select(*keys, F.col("_b.c").alias(choice), (-F.col("_b.m")).alias("w"), "total")
    return out.where((F.col("w") >= least) & (F.col("w") >= least_share * F.col("total")))


def sole_owner(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys that exactly one owner holds, with it; shared keys are left out."""
    return rows.where(present(F.col(key)).isNotNull()).groupBy(key).agg(F.min(owner).alias(owner), F.max(owner).alias("_high")).where(F.col(owner) == F.col("_high")).drop("_high")


def majority(rows: DataFrame, keys: Sequence[str], kind: str, main: Mapping[str, str], other: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    """The class that most of a key's rows belong to, by ``main`` if any of its kinds are there, else by ``other``; ties go by ``order``."""
    pick = lambda table: F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(kind))
    classed = rows.select(*keys, F.coalesce(F.when(pick(main).isNotNull(), F.struct(F.lit(0).alias("t"), pick(main).alias("c"))), F.when(pick(other).isNotNull(), F.struct(F.lit(1).alias("t"), pick(other).alias("c")))).alias("x")).where("x IS NOT NULL")
    counts = classed.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("x.c"))
    return counts.groupBy(*keys).agg(F.min(F.struct(F.col("x.t"), -F.col("n"), place, F.col("x.c").alias("c")))["c"].alias("category"))


# Lookups


def match_in_order(probes: DataFrame, probe_id: str, targets: DataFrame, attempts: Sequence[tuple[Mapping[str, str], str]], target_order: Sequence[str], target_id: str) -> DataFrame:
    """The target that each probe finds by the first of several keys that finds any: ``probe_id, target_id, attempt``.

    An attempt is ({probe column: target column}, label); keys compare without case and '' or NULL never match. Among
    the targets of one key the first by ``target_order`` and id is taken, before the join, so a key shared by many
    targets adds no rows. All attempts run as one union, and the earliest that hit wins in one aggregation.
    """
    low = lambda c, dtype: F.lower(c) if dtype == "string" else c
    p_types, t_types = dict(probes.dtypes), dict(targets.dtypes)
    out = None
    for i, (on, label) in enumerate(attempts):
        names = [f"_k{j}" for j in range(len(on))]
        left = probes.select(F.col(probe_id).alias("_p"), *(low(F.col(p), p_types[p]).alias(n) for n, p in zip(names, on)))
        right = targets.select(F.col(target_id).alias("_t"), *(F.col(o).alias(f"_o{j}") for j, o in enumerate(target_order)), *(low(F.col(t), t_types[t]).alias(n) for n, t in zip(names, on.values())))
        for n in names:
            left, right = left.where(F.col(n).isNotNull() & (F.col(n).cast("string") != "")), right.where(F.col(n).isNotNull() & (F.col(n).cast("string") != ""))
        right = right.groupBy(*names).agg(F.min(F.struct(*(f"_o{j}" for j in range(len(target_order))), "_t"))["_t"].alias("_t"))
        hit = left.join(right, names).select("_p", F.struct(F.lit(i).alias("i"), F.lit(label).alias("attempt"), F.col("_t").alias("t")).alias("h"))
        out = hit if out is None else out.unionByName(hit)
    best = out.groupBy("_p").agg(F.min("h").alias("h"))
    return best.select(F.col("_p").alias(probe_id), F.col("h.t").alias(target_id), F.col("h.attempt").alias("attempt"))


#: So many targets in all are sent to every task; more of them meet the probes in sorted windows.
FEW_TARGETS = 1000


def nearest_in_time(probes: DataFrame, targets: DataFrame, keys: Sequence[str], probe_time: str, target_time: str, target_order: Sequence[str], *, few: int = FEW_TARGETS) -> DataFrame:
    """Each probe with the target of its keys that is nearest in time; of two as near the earlier, then by ``target_order``.

    Up to ``few`` targets (counted first) are broadcast as one list for each key, so no key is sent to one task. Of
    more, only the last target before a probe and the first one after it can be nearest: both come from running
    windows over the union of probes and targets, one up and one down in time, so no probe is paired with all targets.
    Probes without a time or a target have no row.
    """
    t_cols = [c for c in targets.columns if c not in keys]
    p_cols = [c for c in probes.columns if c not in keys]
    packed = F.struct(*(F.col(c) for c in t_cols))
    timed = probes.where(F.col(probe_time).isNotNull())
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    w = Window.partitionBy(*keys, target_time).orderBy(*target_order)
    firsts = targets.where(F.col(target_time).isNotNull()).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    if targets.limit(few + 1).count() <= few:
        lists = firsts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(micros(F.col(target_time)).alias("_at"), packed.alias("_t")))).alias("_l"))
        near = F.array_min(F.transform("_l", lambda x: F.struct(F.abs(x["_at"] - micros(F.col(probe_time))).alias("_gap"), x["_at"].alias("_at"), x["_t"].alias("_t"))))
        found = timed.join(F.broadcast(lists), list(keys)).withColumn("_n", near["_t"])
        return found.select(*keys, *p_cols, *(F.col("_n")[c].alias(f"nearest_{c}") for c in t_cols))
    left = timed.select(*keys, F.struct(*p_cols).alias("_p"), F.lit(None).cast(targets.select(packed.alias("x")).schema["x"].dataType).alias("_t"), F.col(probe_time).cast("timestamp").alias("_at"))
    right = firsts.select(*keys, F.lit(None).cast(left.schema["_p"].dataType).alias("_p"), packed.alias("_t"), F.col(target_time).cast("timestamp").alias("_at"))
    run = lambda *order: Window.partitionBy(*keys).orderBy(*order, F.col("_p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right)
    both = both.withColumn("_before", F.last("_t", ignorenulls=True).over(run("_at"))).withColumn("_after", F.last("_t", ignorenulls=True).over(run(F.col("_at").desc())))
    gap = lambda c: F.abs(F.unix_micros(F.col("_at")) - micros(F.col(c)[target_time]))
    pick = F.when(F.col("_before").isNull(), F.col("_after")).when(F.col("_after").isNull() | (gap("_before") <= gap("_after")), F.col("_before")).otherwise(F.col("_after"))
    found = both.where("_p IS NOT NULL").withColumn("_n", pick).where("_n IS NOT NULL")
    return found.select(*keys, "_p.*", *(F.col("_n")[c].alias(f"nearest_{c}") for c in t_cols))


def rule_join(rows: DataFrame, text: str, rules: Sequence[tuple[str, str]], default: str = "") -> Column:
    """The label of the first rule (pattern, label) that a text matches, in the order given; no case. A chain of JVM regular expressions."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(F.col(text).rlike(f"(?i){pattern}"), F.lit(label)).otherwise(out)
    return out


def name_lookup(rows: DataFrame, name: str, platform: str, listed: DataFrame) -> DataFrame:
    """``rows`` with ``series_id`` of the first listed (``key, platform, ord, id``) name of the same comparison form and platform, NULL if none."""
    best = listed.groupBy("key", F.col("platform").alias("_pl")).agg(F.min(F.struct("ord", "id"))["id"].alias("series_id"))
    keyed = rows.withColumn("_key", N.ascii_words(F.col(name)))
    return keyed.join(best, (keyed["_key"] == best["key"]) & (keyed[platform] == best["_pl"]), "left").drop("_key", "key", "_pl")


#: A title stands for another if so much of the shorter one's words are shared, and so much of all words.
CONTAINMENT, OVERLAP = 0.75, 0.40


def fuzzy_titles(probes: DataFrame, titles: DataFrame, group: str) -> DataFrame:
    """The title of the same group that each probe title stands for: ``probe_id, title_id, how``.

    ``probes``: group, probe_id, title; ``titles``: group, title_id, title, ord. Equal keys decide first (the first
    title by ``ord``). Otherwise the title that shares most words wins, by containment in the shorter and then by
    overlap, ties to the first; it must then reach both thresholds. Titles are joined by shared words within the group,
    never all with all.
    """
    keyed = lambda df: df.withColumn("k", F.explode(N.title_keys(F.col("title"))))
    p = keyed(probes).select(group, "probe_id", "k", F.array_position(N.title_keys(F.col("title")), F.col("k")).alias("way"))
    exact = p.join(keyed(titles).groupBy(group, "k").agg(F.min(F.struct("ord", "title_id"))["title_id"].alias("title_id")), [group, "k"])
    exact = exact.groupBy("probe_id").agg(F.min(F.struct("way", "title_id"))["title_id"].alias("title_id")).withColumn("how", F.lit("exact"))
    worded = lambda df, i: df.select(group, i, *([] if i == "probe_id" else ["ord"]), N.title_words(F.col("title")).alias("w"))
    left = worded(probes.join(exact.select("probe_id"), "probe_id", "left_anti"), "probe_id").withColumn("n", F.size("w"))
    right = worded(titles, "title_id").withColumn("m", F.size("w"))
    shared = left.withColumn("x", F.explode("w")).drop("w").join(right.withColumn("x", F.explode("w")).drop("w"), [group, "x"])
    shared = shared.groupBy("probe_id", "title_id", "ord", "n", "m").agg(F.count(F.lit(1)).alias("c"))
    scored = shared.select("probe_id", "title_id", "ord", (F.col("c") / F.least("n", "m")).alias("containment"), (F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).alias("overlap"))
    best = scored.groupBy("probe_id").agg(F.min(F.struct((-F.col("containment")).alias("a"), (-F.col("overlap")).alias("b"), "ord", "title_id")).alias("s"))
    near = best.where((-F.col("s.a") >= CONTAINMENT) & (-F.col("s.b") >= OVERLAP)).select("probe_id", F.col("s.title_id").alias("title_id"), F.lit("words").alias("how"))
    return exact.unionByName(near)


def shared_prefixes(addresses: DataFrame, column: str, least: int = 50) -> DataFrame:
    """Each different address with its longest beginning, up to a "/", that ``least`` different addresses share ('' if none), and the rest.

    Every address has the root among its beginnings; such hot beginnings meet a broadcast (``lookup_join``).
    """
    urls = cut(addresses.where(F.col(column).isNotNull()).select(F.col(column).alias("address")).distinct())
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.length("address"), F.lit(1))), lambda i: F.substring(F.col("address"), i, 1) == "/")
    heads = urls.select("address", F.explode(F.transform(cuts, lambda i: F.substring(F.col("address"), 1, i))).alias("prefix"))
    common = heads.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    best = lookup_join(heads, common.select("prefix"), "prefix", "inner").groupBy("address").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    out = urls.join(best, "address", "left").withColumn("prefix", F.coalesce("prefix", F.lit("")))
    return out.withColumn("rest", F.expr("substring(address, length(prefix) + 1)"))


# Windows


def islands(rows: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Runs of consecutive numbers within each key: ``first, last, n``."""
    w = Window.partitionBy(*keys).orderBy(number)
    runs = rows.select(*keys, number).where(F.col(number).isNotNull()).distinct().withColumn("_g", F.col(number) - F.row_number().over(w))
    return runs.groupBy(*keys, "_g").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n")).drop("_g")


def fill_forward(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Absent values replaced by the last present one before them within the key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    types = dict(rows.dtypes)
    value = lambda c: present(F.col(c)) if types[c] == "string" else F.col(c)
    return rows.withColumns({c: F.last(value(c), ignorenulls=True).over(w) for c in columns})


def ranked_in(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank", start: int = 1) -> DataFrame:
    """``rows`` numbered within each key in a total order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + (start - 1))


def first_n_distinct(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` different values of each key in order of first appearance: ``place`` from 1."""
    firsts = rows.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_at"))
    return firsts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_at", value))).where(F.col("place") <= n).drop("_at")


# Tables that change


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def latest_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key, the first in ``order``."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def replace_partition(old: DataFrame, new: DataFrame, key: str, member: str) -> tuple[DataFrame, DataFrame]:
    """``old`` with all rows of the keys that occur in ``new`` replaced, and the rows of ``new`` whose (key, member) is new."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new), new.join(old.select(key, member), [key, member], "left_anti")


def without_folder(rows: DataFrame, path: str, folder: str) -> DataFrame:
    """Rows whose path does not lie in a folder."""
    return rows.where(~F.col(path).startswith(folder.rstrip("/") + "/"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, compared: Sequence[str], failed: str | None = None) -> DataFrame:
    """Every key of two snapshots with its change: new, gone, changed or unchanged (a row that had ``failed`` counts as changed)."""
    a, b = old.select(F.col(key), F.struct(*compared).alias("_a"), (F.col(failed) if failed else F.lit("")).alias("_f")), new.select(F.col(key), F.struct(*compared).alias("_b"))
    both = a.join(b, key, "full")
    same = F.col("_a").eqNullSafe(F.col("_b")) & (F.coalesce("_f", F.lit("")) == "")
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(same, "unchanged").otherwise("changed")
    return both.select(key, change.alias("change"))


def with_overrides(rows: DataFrame, key: str, overrides: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` in which the columns of overridden keys have the override's value, also where that is NULL."""
    o = overrides.select(F.col(key), F.lit(True).alias("_o"), *(F.col(c).alias(f"_{c}") for c in columns))
    j = rows.join(o, key, "left")
    return j.select(*(F.when(F.col("_o"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def counts_by(rows: DataFrame, facets: Mapping[str, Column]) -> DataFrame:
    """How many rows each present value of several facets has, in one pass: ``facet, value, n``."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), c.cast("string").alias("value")) for f, c in facets.items()))).alias("x")).select("x.*")
    return long.where(present(F.col("value")).isNotNull()).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
