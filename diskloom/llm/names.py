"""Variant spellings of names typed by people, linked to one entity."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diskloom.functions.strings import consonants, edit_distance, single, sound
from diskloom.functions.text import plain, says_nothing, split_camel, unleet
from diskloom.llm.components import connected_groups, string_codes
from diskloom.session import cut

# Words of a crew's name that do not tell it from others.
_FILLERS = frozenset("the teh hte thee of and crew cru crw creww group grp groop gang inc ltd uk usa st amiga posse possee team".split())
#: Edits (Levenshtein) within which whole names are looked for, and (with swaps as one) within which they are linked.
SEARCH_EDITS, NAME_EDITS, WORD_EDITS = 3, 3, 2  # a short word may hold WORD_EDITS at most
#: Members, and their share of the shorter list, that the records of one crew must have in common.
SHARED_MEMBERS, SHARED_SHARE = 3, 0.6
_SKELETON = str.maketrans("cqzw", "kksv")


def bones(word: str) -> str:
    """The consonants of a word with those that sound alike made equal, repeated ones once."""
    return single(consonants(word).translate(_SKELETON))


def parse_crew(value: str | None) -> tuple[str, list[str]]:
    """What form of a name was typed, and its telling words in lower case.

    Forms: ``none`` (says nothing), ``joint`` (two crews), ``full`` (two words), ``glued`` (words run together),
    ``bare`` (words without vowels), ``cut`` (abbreviated words), ``initial`` (a word and an initial), ``one`` (one
    word), ``long`` (more words than three; two crews or one, which only other names can tell).
    """
    if says_nothing(value):
        return "none", []
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", plain(value))
    tokens = re.findall(r"[A-Za-z0-9@$]+\.?", split_camel(text))
    if len(tokens) > 5 and all(len(t.rstrip(".")) == 1 for t in tokens):
        return "glued", ["".join(tokens).lower()]
    words, dotted = [], []
    for i, t in enumerate(tokens):
        w = re.sub("[^a-z]", "", unleet(t.rstrip(".")).lower())
        if not w or w in _FILLERS or (w in "no" and 0 < i < len(tokens) - 1 and not t.endswith(".")):
            continue
        words.append(w)
        dotted.append(t.endswith("."))
    if len(words) == 3:  # one of them may be a mistyped filler
        for most in (1, 2):
            near = [i for i, w in enumerate(words) if len(w) <= 4 + most and any(edit_distance(w, f, most) <= most for f in _FILLERS if len(f) >= max(2, len(w) - most))]
            if len(near) == 1 and (most == 1 or min(len(w) for i, w in enumerate(words) if i != near[0]) > 5):
                del words[near[0]], dotted[near[0]]
                break
    if len(words) > 2 and re.search(r"\S\s+[-/+&]\s+\S", text):
        return "joint", words
    if len(words) > 3:
        return "long", words
    if not words:
        return "none", []
    if len(words) == 1:
        return ("glued" if len(words[0]) > 12 else "one"), words
    if len(words) == 2:
        if min(map(len, words)) == 1:
            return ("initial", sorted(words, key=len, reverse=True)) if max(map(len, words)) > 2 else ("none", [])
        if all(dotted) and max(map(len, words)) <= 7:
            return "cut", words
        if not any(re.search("[aeiou]", w) for w in words):
            return "bare", words
        return "full", words
    return "glued", ["".join(words)]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parsed values with the key of their node: whole names by the sound of their words in order of the alphabet, long ones as typed, and the keys of a long one's halves."""
    for b in batches:
        rows = []
        for v in b["value"]:
            form, words = parse_crew(v)
            halves: list[str] = []
            if form == "long":
                halves = [f"full:{' '.join(sorted(map(sound, h)))}" for h in (words[: len(words) // 2], words[len(words) // 2 :])]
                form, words = "glued", ["".join(words)]
            key = " ".join(sorted(map(sound, words))) if form in ("full", "glued") else " ".join(words)
            rows.append((v, form, words, f"{'full' if form == 'glued' else form}:{key}", halves))
        yield pd.DataFrame(rows, columns=["value", "form", "words", "node", "halves"])


def segments(length: int, pieces: int) -> list[tuple[int, int]]:
    """Start and length of the ``pieces`` nearly equal parts of a string."""
    base, more = divmod(length, pieces)
    out, at = [], 0
    for i in range(pieces):
        n = base + (i >= pieces - more)
        out.append((at, n))
        at += n
    return out


def _shorter(s: str) -> set[str]:
    """A string and what is left of it without one letter."""
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}


def _segment_index(k: int):
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f"{scope}|{len(s)}|{i}|{s[p : p + n]}", node, s) for scope, node, s in zip(b["scope"], b["node"], b["text"]) if len(s) > k for i, (p, n) in enumerate(segments(len(s), k + 1))]
            rows += [(f"{scope}|~{v}", node, s) for scope, node, s in zip(b["scope"], b["node"], b["text"]) if len(s) <= k for v in _shorter(s)]
            yield pd.DataFrame(rows, columns=["key", "node", "text"])

    return emit


def _segment_probes(k: int):
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for scope, node, s in zip(b["scope"], b["node"], b["text"]):
                r = len(s)
                if r <= k:
                    rows += [(f"{scope}|~{v}", node, s) for v in _shorter(s)]
                for length in range(max(k + 1, r - k), r + k + 1):
                    gap = r - length  # below 0 for longer strings
                    for i, (p, n) in enumerate(segments(length, k + 1)):
                        for at in range(max(0, p - (k - gap) // 2), min(r - n, p + (k + gap) // 2) + 1):
                            rows.append((f"{scope}|{length}|{i}|{s[at : at + n]}", node, s))
            yield pd.DataFrame(rows, columns=["key", "other", "probe"]).drop_duplicates()

    return emit


def near_strings(index: DataFrame, probes: DataFrame, k: int = SEARCH_EDITS) -> DataFrame:
    """Candidate pairs (``node, text, other, probe``) of strings that may lie within ``k`` edits.

    Each string of ``index`` (``node, text``) is cut into k + 1 segments; within k edits one of them must survive, and
    it can have moved by no more than the edits allow. Each string of ``probes`` looks up its substrings of the right
    length at those places, for strings of every length that ``k`` edits can reach. Among
    strings of k letters or fewer, any two would lie within k edits; those within one edit meet by leaving out a letter.
    A column ``scope`` in both keeps pairs within one scope.
    """
    if "scope" not in index.columns:
        index, probes = index.withColumn("scope", F.lit("")), probes.withColumn("scope", F.lit(""))
    left = index.mapInPandas(_segment_index(k), "key string, node string, text string")
    right = probes.mapInPandas(_segment_probes(k), "key string, other string, probe string")
    return left.join(right, "key").where("node <> other").select("node", "text", "other", "probe").distinct()


def same_name(a: list[str], b: list[str]) -> bool:
    """Whether two whole names (words by sound) are one: within NAME_EDITS in all, in either order."""
    x, y = "".join(a), "".join(b)
    if len(a) == len(b) == 2:
        for c in (b, b[::-1]):
            one, two = (min(edit_distance(x, y, NAME_EDITS), edit_distance(single(x), single(y), NAME_EDITS)) for x, y in zip(a, c))
            if one + two <= NAME_EDITS and (max(one, two) <= WORD_EDITS or min(map(len, (*a, *c))) > 6):
                return True
        return False
    return any(edit_distance(p, q, 2) <= 2 for p in ({x} if len(a) == 1 else {x, "".join(a[::-1])}) for q in ({y} if len(b) == 1 else {y, "".join(b[::-1])}))


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = [same_name(a.split(":", 1)[1].split(), c.split(":", 1)[1].split()) for a, c in zip(b["node"], b["other"])]
        yield b.loc[keep, ["node", "other"]].rename(columns={"node": "a", "other": "b"})


def _whole_edges(nodes: DataFrame) -> DataFrame:
    """Pairs of whole names that are spellings of one name."""
    key = F.substring_index("node", ":", -1)
    index = nodes.where("node LIKE 'full:%'").select("node", F.regexp_replace(key, " ", "").alias("text"))
    turned = F.concat(F.substring_index(key, " ", -1), F.substring_index(key, " ", 1))
    probes = index.unionByName(nodes.where("node LIKE 'full:% %'").select("node", turned.alias("text")))
    candidates = near_strings(index, probes).select("node", "other").distinct()
    return candidates.mapInPandas(_verify, "a string, b string")


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Short forms under which a whole two-word name may appear: (group, key)."""
    for b in batches:
        rows = set()
        for group, (v, w) in zip(b["grp"], b["words"]):
            rows.add((group, "bare:" + " ".join(sorted((bones(v), bones(w))))))
            rows.add((group, "cut:" + " ".join(sorted((v[:3], w[:3])))))
            for x, y in ((v, w), (w, v)):
                rows |= {(group, f"initial:{x} {y[0]}"), (group, f"one:{x}"), (group, f"one:{x}s")}
        yield pd.DataFrame(sorted(rows), columns=["grp", "key"])


def _short_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for node, form, words in zip(b["node"], b["form"], b["words"]):
            words = list(words)
            if form == "bare":
                key = "bare:" + " ".join(sorted(map(bones, words)))
            elif form == "cut":
                key = "cut:" + " ".join(sorted(w[:3] for w in words))
            else:
                key = node
            rows.append((node, key, words))
        yield pd.DataFrame(rows, columns=["node", "key", "words"])


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keeps candidates of abbreviated names whose every word begins the matched name's word."""
    for b in batches:
        keep = [
            not k.startswith("cut:") or any(all(x.startswith(p) for p, x in zip(words, o)) for o in (list(full), list(full)[::-1]))
            for k, words, full in zip(b["key"], b["words"], b["full"])
        ]
        yield b.loc[keep, ["node", "grp"]]


#: Pairs of members that are handed on at a time, so long rosters take no more memory.
PAIR_BATCH = 50_000


def _member_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple[str, int, str]] = []
    for b in batches:
        for roster, m in zip(b["roster"], b["members"]):
            m = list(m)
            for i in range(len(m) - 1):
                rows += [(roster, len(m), f"{m[i]}\x1f{y}") for y in m[i + 1 :]]
                if len(rows) >= PAIR_BATCH:
                    yield pd.DataFrame(rows, columns=["roster", "n", "pair"])
                    rows = []
    yield pd.DataFrame(rows, columns=["roster", "n", "pair"])


def _rosters(known: DataFrame) -> DataFrame:
    """``node, roster, members, n``: each name's lists of two members or more, equal lists under one key."""
    lists = known.select("node", F.array_sort(F.array_distinct("members")).alias("members")).where(F.size("members") >= 2)
    return lists.select("node", F.concat_ws("\x1f", "members").alias("roster"), "members", F.size("members").alias("n")).distinct()


def _shared_members(rosters: DataFrame) -> DataFrame:
    """Different rosters that share two members or more: ``a, b, s`` (how many) and ``n`` (of the shorter).

    Rosters meet by pairs of members, which are far rarer than members; equal rosters are one, so the many spellings
    of a crew with one list do not multiply. ``s`` shared members make s (s - 1) / 2 shared pairs.
    """
    pairs = cut(rosters.select("roster", "members").distinct().mapInPandas(_member_pairs, "roster string, n int, pair string"))
    met = pairs.select(F.col("roster").alias("a"), F.col("n").alias("n_a"), "pair").join(pairs.select(F.col("roster").alias("b"), F.col("n").alias("n_b"), "pair"), "pair").where("a < b")
    met = met.groupBy("a", "b", F.least("n_a", "n_b").alias("n")).agg(F.count(F.lit(1)).alias("shared"))
    return met.select("a", "b", "n", F.round((1 + F.sqrt(1 + 8 * F.col("shared"))) / 2).cast("int").alias("s"))


def _weak_members(rosters: DataFrame, shared: DataFrame, whole: DataFrame, settled: DataFrame) -> DataFrame:
    """``node, grp``: short names that fit no whole name by letters, with the only group that most of their lists of two members are in.

    Two lists may share two members by chance, so this decides only for names (not in ``settled``) that nothing else
    places. Names vote by roster, so a roster that very many names have is counted, not multiplied.
    """
    both = shared.where("s = 2 AND n = 2").select("a", "b")
    ways = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(rosters.where("n = 2").select(F.col("roster").alias("a"), F.col("roster").alias("b")).distinct())
    full = rosters.join(whole, "node").groupBy(F.col("roster").alias("b"), "grp").agg(F.count(F.lit(1)).alias("v"))
    votes = ways.join(full, "b").groupBy(F.col("a").alias("roster"), "grp").agg(F.sum("v").alias("v"))
    open_ = rosters.where("node NOT LIKE 'full:%'").join(settled, "node", "left_anti").select("node", "roster")
    votes = open_.join(votes, "roster").groupBy("node", "grp").agg(F.sum("v").alias("v"))
    top = votes.groupBy("node").agg(F.max("v").alias("v"))
    return votes.join(top, ["node", "v"]).groupBy("node").agg(F.min("grp").alias("grp"), F.max("grp").alias("high")).where("grp = high").select("node", "grp")


def _group(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Group of every node under string edges ``a, b``: ``node, grp`` (a node without edges is its own group)."""
    edges = cut(edges)
    code = string_codes(nodes.select("node").unionByName(edges.select(F.col("a").alias("node"))).unionByName(edges.select(F.col("b").alias("node"))), "node")
    lows = connected_groups(edges.select(code("a").alias("src"), code("b").alias("dst")))
    coded = nodes.select("node", code("node").alias("code"))
    return coded.join(lows.withColumnRenamed("node", "code"), "code", "left").select("node", F.coalesce("lo", "code").alias("grp"))


def name_groups(values: DataFrame, rosters: DataFrame | None = None) -> DataFrame:
    """The entity that each distinct typed name (column ``value``) stands for: ``value, grp``.

    Whole names are compared by the sound of their folded words: a pigeonhole segment join (``near_strings``) over the
    words run together, in either order, gives the candidates, and a banded edit distance per word decides. Then names
    typed short (without vowels, abbreviated, with an initial, one word only) join the group of whole names that they
    fit, if it is the only one. Names whose records (``rosters``: ``value, members``) list the same members are one as
    well; that finds a crew's other names and decides between several fitting groups.

    A name of more than three words is one entity, unless both its halves are known as whole names themselves. Values
    that say nothing or name two entities together have no row. NULL and repeated values, and empty tables,
    change nothing.
    """
    parsed = cut(values.where("value IS NOT NULL").select("value").distinct().mapInPandas(_parse, "value string, form string, words array<string>, node string, halves array<string>").where("form NOT IN ('none', 'joint')"))
    halves = parsed.where(F.size("halves") > 0).select("value", F.explode("halves").alias("node"))
    if not halves.isEmpty():  # a long name whose halves are both known as crews names two
        two = halves.join(parsed.where("form = 'full'").select("node").distinct(), "node", "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        parsed = cut(parsed.join(two, "value", "left_anti"))
    nodes = parsed.select("node").distinct()
    whole = nodes.where("node LIKE 'full:%'")
    first = cut(_group(_whole_edges(nodes), whole))
    full = parsed.where("form = 'full'").join(first, "node").select("grp", "words").distinct()
    short = parsed.where("form NOT IN ('full', 'glued')").select("node", "form", "words").distinct().mapInPandas(_short_keys, "node string, key string, words array<string>").distinct()
    keys = full.mapInPandas(_forms, "grp bigint, key string").distinct()
    fits = short.join(keys, "key")
    plain_fit = fits.where("key NOT LIKE 'cut:%'").select("node", "grp")
    cut_fit = fits.where("key LIKE 'cut:%'").join(full.select("grp", F.col("words").alias("full")), "grp").select("node", "key", "words", "grp", "full").mapInPandas(_starts, "node string, grp bigint")
    lexical = cut(plain_fit.unionByName(cut_fit).groupBy("node").agg(F.min("grp").alias("grp"), F.max("grp").alias("high")).where("grp = high").select("node", "grp"))
    as_node = lambda c: F.concat(F.lit("#"), F.col(c).cast("string"))
    edges = lexical.select(F.col("node").alias("a"), as_node("grp").alias("b")).unionByName(first.select(F.col("node").alias("a"), as_node("grp").alias("b")))
    if rosters is not None:
        known = rosters.where("value IS NOT NULL").join(parsed.select("value", "node"), "value").select("node", "members")
        rosters = cut(_rosters(known))
        shared = cut(_shared_members(rosters))
        alike = shared.where((F.col("s") >= SHARED_MEMBERS) & (F.col("s") >= SHARED_SHARE * F.col("n"))).select("a", "b")
        as_roster = lambda c: F.concat(F.lit("@"), F.col(c))
        strong = rosters.where(F.col("n") >= SHARED_MEMBERS)
        several = strong.groupBy("roster").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("roster").unionByName(alike.select(F.col("a").alias("roster"))).unionByName(alike.select(F.col("b").alias("roster"))).distinct()
        settled = lexical.select("node").unionByName(strong.join(several, "roster", "left_semi").select("node")).distinct()
        edges = edges.unionByName(strong.select(F.col("node").alias("a"), as_roster("roster").alias("b"))).unionByName(alike.select(as_roster("a").alias("a"), as_roster("b").alias("b")))
        edges = edges.unionByName(_weak_members(rosters, shared, first, settled).select(F.col("node").alias("a"), as_node("grp").alias("b")))
    final = _group(edges, nodes)
    return parsed.join(final, "node").select("value", "grp")


def variant_pairs(values: DataFrame, rosters: DataFrame | None = None) -> DataFrame:
    """Every two different values of one entity, the first in byte order first: ``name_a, name_b``.

    A group holds the spellings of one name, so its size is bounded by how many ways a name is written, not by the
    rows: repeated values are one. Values of groups of one give no row.
    """
    groups = cut(name_groups(values, rosters))
    a, b = groups.select("grp", F.col("value").alias("name_a")), groups.select("grp", F.col("value").alias("name_b"))
    return a.join(b, "grp").where("name_a < name_b").select("name_a", "name_b").distinct()
