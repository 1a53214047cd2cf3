"""Groups of records that are linked directly or through others (connected components over pairs)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diskloom.operators.skew import lookup_join
from diskloom.session import cut

#: Pairs that one cell of the grid holds on average.
CELL_EDGES = 50_000
#: Pairs of one vertex, owning up to a third of all pairs, that one cell may get.
CELL_HOT_EDGES = 1_000_000


def _priority(nodes: np.ndarray, salt: int) -> np.ndarray:
    """A random-looking order of vertices (the finaliser of splitmix64), other in each round."""
    with np.errstate(over="ignore"):
        x = nodes.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def union_find(src: np.ndarray, dst: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Root of each vertex 0..n-1 under the pairs (src, dst); the root is the vertex first in ``order`` (lowest value)."""
    parent = list(range(len(order)))
    rank = order.tolist()
    for a, b in zip(src.tolist(), dst.tolist()):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            if rank[b] < rank[a] or (rank[a] == rank[b] and b < a):
                a, b = b, a
            parent[b] = a
    roots = np.asarray(parent, dtype=np.int64)
    while not np.array_equal(roots, up := roots[roots]):
        roots = up
    return roots


def _solve_cell(salt: int):
    def solve(cell: pd.DataFrame) -> pd.DataFrame:
        n = len(cell)
        nodes, at = np.unique(np.concatenate([cell["src"].to_numpy(), cell["dst"].to_numpy()]), return_inverse=True)
        order = _priority(nodes, salt)
        roots = union_find(at[:n], at[n:], order)
        return pd.DataFrame({"node": nodes, "rep": nodes[roots], "prio": order[roots]})

    return solve


def connected_groups(pairs: DataFrame, *, cell_edges: int = CELL_EDGES, cell_hot_edges: int = CELL_HOT_EDGES, max_rounds: int = 64) -> DataFrame:
    """Give every vertex of ``pairs`` (bigint columns ``src``, ``dst``) the smallest vertex of its group: ``node, lo``.

    Vertices are hashed into g blocks and each pair goes to the cell (block of one end, block of the other) of a
    g x g grid, of which one half is used as pairs have no direction. A local union-find in each cell gives each
    vertex a representative there. The representatives that a vertex got in the cells of its row and column are then
    exchanged: the first of them in a random order becomes its parent and is paired with the others. Those pairs are
    the (smaller) input of the next round, until no vertex has two representatives. Each round removes a constant
    share of the vertices in expectation, whatever the shape of the chains.

    The hash spreads a vertex with a third of all pairs over the g cells of its row; g grows with the pairs so that a
    cell keeps about ``cell_edges`` pairs, and with the largest degree so that it gets no more than about
    ``cell_hot_edges`` of one vertex. Rounds are cut by
    checkpoints in the shared folder. Pairs with a NULL end are left out; a pair of a vertex with itself gives a group
    of one; repeated pairs and either order change nothing; no pairs give no rows.
    """
    given = pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    given = cut(given.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    loops, edges = given.where("src = dst").select(F.col("src").alias("node")), given.where("src <> dst")
    steps: list[DataFrame] = []
    for salt in range(max_rounds):
        n = edges.count()
        if not n:
            break
        g = math.ceil((math.sqrt(8 * n / cell_edges + 1) - 1) / 2)  # g (g + 1) / 2 cells
        if n > cell_hot_edges * g:  # only then can a vertex have more pairs than its cells should hold
            ends = edges.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
            g = max(g, math.ceil(ends.agg(F.max("d")).first()[0] / cell_hot_edges))
        block = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(salt)), F.lit(g))
        cells = edges.withColumn("_a", block("src")).withColumn("_b", block("dst"))
        cells = cells.withColumn("row", F.least("_a", "_b")).withColumn("col", F.greatest("_a", "_b"))
        local = cells.groupBy("row", "col").applyInPandas(_solve_cell(salt), "node long, rep long, prio long")
        met = local.groupBy("node").agg(F.min(F.struct("prio", "rep"))["rep"].alias("parent"), F.collect_set("rep").alias("reps"))
        met = cut(met)  # at most 2 g - 1 representatives a vertex
        steps.append(met.select("node", "parent"))
        if g == 1:  # one cell has settled all there was
            break
        edges = met.where(F.size("reps") > 1).select("parent", F.explode("reps").alias("rep")).where("parent <> rep")
        edges = cut(edges.select(F.least("parent", "rep").alias("src"), F.greatest("parent", "rep").alias("dst")).distinct())
    else:
        raise RuntimeError(f"groups did not settle in {max_rounds} rounds")
    if not steps:
        return loops.select("node", F.col("node").alias("lo"))
    found = steps[-1]
    for step in reversed(steps[:-1]):
        higher = found.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        found = cut(lookup_join(step, higher, "parent").select("node", F.coalesce("root", "parent").alias("parent")))
    lows = found.groupBy("parent").agg(F.min("node").alias("lo"))
    found = lookup_join(found, lows, "parent", "inner").select("node", "lo")
    return found.unionByName(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("lo")))


def string_codes(nodes: DataFrame, column: str, hash_of: Callable[[Column], Column] = F.xxhash64) -> Callable[[Column | str], Column]:
    """A function from a column of strings to whole numbers, different for every two strings of ``nodes``.

    Numbers are 64-bit hashes. Whether two strings share one is checked, not hoped for: of such strings (about
    n squared / 2^65 of n) each gets a number of its own below 0, hashes being 0 or more.
    """
    code = lambda c: hash_of(F.col(c) if isinstance(c, str) else c).cast("long").bitwiseAND(F.lit(2**63 - 1))
    shared = nodes.select(F.col(column).alias("s")).distinct().groupBy(code("s").alias("h")).agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo < hi").select("h")
    hashes = [r[0] for r in shared.collect()]  # none but for billions of strings
    if not hashes:
        return code
    twins = sorted(r[0] for r in nodes.select(F.col(column).alias("s")).where(code("s").isin(hashes)).distinct().collect())

    def coded(c: Column | str) -> Column:
        text = F.col(c) if isinstance(c, str) else c
        return F.coalesce(F.try_element_at(F.create_map(*(x for i, t in enumerate(twins) for x in (F.lit(t), F.lit(-1 - i)))), text).cast("long"), code(text))

    return coded


#: Added to an image's id to make its vertex, so that a disc comes before any image and equal ids stay two things.
IMAGE = 1 << 61


def verdict_groups(verdicts: DataFrame, **parameters) -> DataFrame:
    """Group of every disc and image that a standing "same" verdict links to another one: ``node_kind, node_id, group_key``.

    The latest verdict (by ``judged_at``, a NULL being the earliest, then by ``pair_id``) on two things, in either
    order, stands. Verdicts and kinds are compared without case and outer white space. Rows with a NULL or negative
    id, another kind or a NULL verdict, and rows about one thing only, link nothing. The key names the smallest disc of
    the group, or its smallest image if it holds no disc. No rows give no rows.
    """
    clean = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    code = lambda side: F.when(F.col(f"{side}_id") < 0, None).when(clean(f"{side}_kind") == "disk", F.col(f"{side}_id")).when(clean(f"{side}_kind") == "image", F.col(f"{side}_id") + F.lit(IMAGE))
    rows = verdicts.select(code("left").alias("l"), code("right").alias("r"), clean("verdict").alias("verdict"), "judged_at", "pair_id")
    rows = rows.where("l IS NOT NULL AND r IS NOT NULL AND l <> r AND verdict IS NOT NULL").select(F.least("l", "r").alias("src"), F.greatest("l", "r").alias("dst"), "verdict", "judged_at", "pair_id")
    standing = rows.groupBy("src", "dst").agg(F.max(F.struct("judged_at", "pair_id", "verdict"))["verdict"].alias("verdict")).where("verdict = 'same'")
    groups = connected_groups(standing.select("src", "dst"), **parameters)
    is_image = F.col("node") >= IMAGE
    key = F.when(F.col("lo") >= IMAGE, F.concat(F.lit("image:"), (F.col("lo") - F.lit(IMAGE)).cast("string"))).otherwise(F.concat(F.lit("disk:"), F.col("lo").cast("string")))
    return groups.select(
        F.when(is_image, "image").otherwise("disk").alias("node_kind"),
        F.when(is_image, F.col("node") - F.lit(IMAGE)).otherwise(F.col("node")).alias("node_id"),
        key.alias("group_key"),
    )
