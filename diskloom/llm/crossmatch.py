"""Matching of records across sources without a common key, by partial and noisy attributes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diskloom.functions.strings import edit_distance
from diskloom.functions.text import plain, says_nothing, split_camel, unleet
from diskloom.llm.components import connected_groups, string_codes
from diskloom.llm.names import near_strings
from diskloom.session import cut

#: A title word is common if it stands beside so many different other words, in however many records: a word of the language, not a name.
COMPANIONS = 8
#: At most so many common words (those with most companions) are given to every task.
MOST_COMMON = 50_000
#: A word is a slip of another (a typing error, or a filler run together with it) if that one has so many times its companions.
SLIP = 5
#: A checksum tells if at most so many titles have it, however many records; or if one title has so much of its records.
FEW_TITLES, ONE_TITLE = 3, 0.5
#: Words whose correction a task remembers; beyond it the memory starts anew.
MOST_KNOWN = 200_000
#: Saturation and length norm of BM25; the norm does not touch titles, which releases of one title share.
K1, B = 1.2, 0.75
#: Weight of a year one off against an equal one, and of a year further off.
NEAR_YEAR, OTHER_YEAR = 0.5, -2.0
#: Releases that are kept of each record's ranking: the nearest and the next.
TOP = 2
#: Records with a known release on which the confidence is calibrated, at most.
LABELLED = 20_000
#: With fewer than this, fixed coefficients stand in: of the constant and of EVIDENCE.
LEAST_LABELLED, UNFITTED = 200, (0.0, 1.5, 2.0, -2.0, -4.0, -0.5)
#: What the confidence of a ranking is made of.
EVIDENCE = ("gap", "alone", "tied", "other_year", "apart")
#: Spellings of publishers of one title that are compared in one task; more of them meet by segments.
MOST_SPELLINGS = 200
# Words that tell nothing in a title, and in a publisher's name.
_FILLERS = frozenset("the a an of and o n".split())
_PUBLISHER_KINDS = "software soft games arts design entertainment productions interactive ltd inc gmbh sa uk usa co corp company llc limited international publishing group ag bv plc".split()
_ROMAN = {"ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
_GLUED_NUMBER = re.compile("(?:viii|vii|vi|iv|ix|v|iii|ii|x|[2-9])$")
_GLUED_FILLERS = frozenset(["", "of", "and", "the", "ofthe", "andthe", "o"])
_PART = re.compile(r"\(\s*(?:disk|disc|part|side)\s*([0-9]+|[a-z])(?:\s*(?:of|/)\s*[0-9]+)?\s*\)|\b(?:disk|disc|part|side)\s*([0-9]+|[a-z])(?:\s*(?:of|/)\s*[0-9]+)\b", re.I)


def part_number(text: str | None) -> int:
    """A part as a number from 1 ("A" and "1" are one), 0 if none is given."""
    t = re.sub("[^0-9a-z]", "", plain(text or "").lower())
    t = re.sub("^(disk|disc|part|side)", "", t)
    if t.isdigit():
        return int(t)
    return ord(t) - 96 if len(t) == 1 else 0


def parse_title(title: str | None) -> tuple[list[str], int, int]:
    """Telling words of a title (abbreviated ones end in "."), its number in a series (1 if none) and the part that it names (0 if none)."""
    text = plain(title or "")
    part = 0
    if m := _PART.search(text):
        part = part_number(m[1] or m[2])
        text = text[: m.start()] + " " + text[m.end() :]
    text = re.sub(r"\[[^\]]*\]|\([^)]*\)", " ", text)
    text = re.sub(r"(?<=[a-z]{3})(?=(?:I{2,3}|IV|V|VI{1,3}|IX|X)\b)", " ", text)
    tokens = re.findall(r"[A-Za-z0-9]+[.…]?", split_camel(re.sub(r"[oO]'(?=\s)", " ", text)).replace("'", ""))
    number = 1
    words = []
    for i, t in enumerate(tokens):
        dotted = t[-1] in ".…"
        w = unleet(t.rstrip(".…")).lower()
        if i and i >= len(tokens) - 2 and (w in _ROMAN or (w.isdigit() and int(w) < 100)):
            number = _ROMAN.get(w) or int(w)
            continue
        w = re.sub("[^a-z0-9]", "", w)
        if w and w not in _FILLERS:
            words.append(w + "." * dotted)
    return words, number, part


def publisher_core(value: str | None) -> str:
    """The telling word of a publisher's name in lower case, '' if it says nothing."""
    if says_nothing(value) or "�" in value:
        return ""
    text = re.sub(r"\([^)]*\)", " ", plain(value))
    if re.search(r"(…|\.\.\.)\s*$", value):
        return ""
    words = [unleet(w).lower() for w in re.findall(r"[A-Za-z0-9]+", split_camel(text)) if len(w) > 1]
    def kind(w: str) -> bool:
        return w in _PUBLISHER_KINDS or any((k.startswith(w) and len(w) >= 3) or edit_distance(w, k, 2) <= (2 if len(k) > 7 else 1 if len(k) > 3 else 0) for k in _PUBLISHER_KINDS)
    telling = [w for w in words if not kind(w)] or words
    if len(telling) == 1 and len(telling[0]) > 8:
        for k in sorted(_PUBLISHER_KINDS, key=len, reverse=True):
            if len(k) > 3 and telling[0].endswith(k) and len(telling[0]) - len(k) > 4:
                return telling[0][: -len(k)]
    return max(telling, key=len, default="")


def year_of(date_text: str | None) -> int:
    """The year that a date names, 0 if it names none for certain ("198x")."""
    m = re.match(r"\s*(\d{4})(?!\d)", plain(date_text or "")) or re.search(r"\b((?:19|20)\d\d)\b", plain(date_text or ""))
    return int(m[1]) if m else 0


def checksum(value: str | None) -> str:
    """A CRC-32 as eight lower-case digits however it is written, '' if absent."""
    t = re.sub("^0x", "", plain(value or "").strip().lower())
    t = re.sub("[^0-9a-f]", "", t)
    return t if len(t) == 8 and t.strip("0") and t.strip("f") else ""


def _parse_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        titles = [parse_title(t) for t in b["title"]]
        yield pd.DataFrame(
            {
                "record_id": b["record_id"],
                "source": b["source"],
                "platform": b["platform"],
                "part": [str(part_number(p) or t[2]) for p, t in zip(b["part"], titles)],
                "number": [str(t[1]) for t in titles],
                "words": [sorted(set(t[0])) for t in titles],
                "year": [year_of(d) for d in b["date_text"]],
                "publisher": [publisher_core(p) for p in b["publisher"]],
                "checksums": [sorted({c for c in map(checksum, cs if cs is not None else []) if c}) for cs in b["checksums"]],
            }
        )


def deletions(word: str, most: int) -> set[str]:
    """The word and all strings that come of it by leaving out up to ``most`` letters."""
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


def _reach(word: str) -> int:
    """Typing errors that a word of this length may hold."""
    return 2 if len(word) >= 7 else 1 if len(word) >= 4 else 0


def common_words(companions: dict[str, int]) -> list[str]:
    """The words that are no slips of others, by how many companions each has."""
    near: dict[str, set[str]] = {}
    for w in companions:
        if len(w) >= 4:
            for v in deletions(w, 1):
                near.setdefault(v, set()).add(w)
    out = []
    for w, n in companions.items():
        others = set().union(*(near.get(v, ()) for v in deletions(w, 1))) if len(w) >= 4 else set()
        bare = {re.sub("(?<=.{4})(?:andthe|ofthe|of|and|the)$", "", w), re.sub("^(?:andthe|ofthe|of|and|the|o)(?=.{4})", "", w)} - {w}
        slip = (len(w) <= 4 and any(edit_distance(w, f, 1) <= 1 for f in ("the", "and", "of"))) or any(companions.get(v, 0) > n for v in bare)
        slip = slip or any(companions[o] >= SLIP * n for o in others if edit_distance(w, o, 1) == 1)
        if not slip:
            out.append(w)
    return sorted(out)


class WordFixer:
    """Puts title words right against the common words of all titles: typing errors, abbreviations, words run together."""

    def __init__(self, common: list[str]):
        self.common = set(common)
        self.long = sorted((w for w in common if len(w) >= 4), key=lambda w: (-len(w), w))
        self.near: dict[str, set[str]] = {}
        for w in self.long:
            for v in deletions(w, _reach(w)):
                self.near.setdefault(v, set()).add(w)
        self.known: dict[str, list[str]] = {}

    def _ranked(self, word: str) -> list[tuple[int, str]]:
        met = set().union(*(self.near.get(v, ()) for v in deletions(word, _reach(word))))
        return sorted((d, w) for w in met if (d := edit_distance(word, w, _reach(w))) <= min(_reach(w), _reach(word)))

    def fits(self, word: str) -> list[str]:
        """All common words that a typed one may stand for by ``same_title``."""
        if word.endswith("."):
            return sorted(w for w in self.common if w.startswith(word[:-1]))
        return [w for _, w in self._ranked(word)]

    def _nearest(self, word: str) -> str:
        ranked = self._ranked(word)
        return ranked[0][1] if ranked and (len(ranked) == 1 or ranked[0][0] < ranked[1][0]) else ""

    def _fix(self, word: str) -> list[str]:
        """The words that a typed one stands for; a number in a series found at its end comes as "#4"."""
        if word in self.common:
            return [word]
        if word.endswith("."):
            fits = [w for w in self.common if w.startswith(word[:-1])]
            return fits if len(fits) == 1 else [word]
        if len(word) <= 4 and any(edit_distance(word, f, 1) <= 1 for f in ("the", "and", "of")):
            return []
        if w := self._nearest(word):
            return [w]
        if m := _GLUED_NUMBER.search(word):
            head = self._fix(word[: m.start()])
            if any(w in self.common for w in head) or len(head) > 1:
                return [*head, f"#{_ROMAN.get(m[0]) or int(m[0])}"]
        if len(word) > 12 and word.startswith("the") and any(word.startswith(w, 3) for w in self.long):
            return self._fix(word[3:])
        for w in self.long:
            if word.endswith(w):
                rest = re.sub("^(?:andthe|ofthe|of|and|the|o)(?=.{4})|(?<=.{4})(?:andthe|ofthe|of|and|the)$", "", word[: -len(w)])
            elif word.startswith(w):
                rest = re.sub("^(?:andthe|ofthe|of|and|the|o)(?=.{4})", "", word[len(w) :])
            else:
                continue
            if rest in _GLUED_FILLERS:
                return [w]
            if len(rest) >= 4:
                return [w, *self._fix(rest)]
        return [re.sub("(?<=.{5})(?:andthe|ofthe)$", "", word)]

    def fix(self, words: list[str]) -> tuple[list[str], int]:
        """The words put right, and the number in a series that was run together with one of them (0 if none was)."""
        out: set[str] = set()
        for w in words:
            if w not in self.known:
                if len(self.known) >= MOST_KNOWN:
                    self.known.clear()
                self.known[w] = self._fix(w)
            out.update(self.known[w])
        number = max((int(w[1:]) for w in out if w[0] == "#"), default=0)
        return sorted(w for w in out if w[0] != "#"), number


def title_terms(words: list[str], fixer: WordFixer) -> Iterator[tuple[str, bool, bool]]:
    """Index terms of a title: ``(term, cut, prefix)``; any two titles that ``same_title`` accepts share one.

    It pairs each word of one title with one of the other. Either two uncommon whole words are paired, and share what
    is left of them after leaving out letters; or an abbreviation is paired with an uncommon word, and they share its
    beginning next to the common words of the others; or each pair holds a common word, and both titles have one form
    in common words alone. A word that may stand for several common words stands for each of them, and for itself.
    """
    usual = [w for w in words if w in fixer.common]
    rare = [w for w in words if w not in fixer.common]
    choices = [fixer.fits(w) for w in rare]
    n = len(words)
    for form in product(*choices):
        yield f"{n}=" + " ".join(sorted([*usual, *form])), False, False
    for i, r in enumerate(rare):
        dotted, stem = r.endswith("."), r.rstrip(".")
        if not dotted:
            for v in deletions(stem, _reach(stem)):
                yield f"{n}~{v}", False, False
        for form in product(*(["", *c] for k, c in enumerate(choices) if k != i)):
            same = " ".join(sorted([*usual, *filter(None, form)]))
            for k in range(1, min(4, len(stem)) + 1):
                yield f"{n}^{stem[:k]}|{same}", dotted and k == min(4, len(stem)), True


def _title_keys(common: list[str]):
    """Index terms of distinct titles, with all that must agree."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fixer = WordFixer(common)
        for b in batches:
            rows = []
            for node, words, platform, part, number in zip(b["node"], b["words"], b["platform"], b["part"], b["number"]):
                base = f"{platform}|{part}|{number}|"
                rows += [(node, base + term, cut, prefix) for term, cut, prefix in title_terms(list(words), fixer)]
            yield pd.DataFrame(rows, columns=["node", "term", "cut", "prefix"]).drop_duplicates()

    return emit


def same_title(a: list[str], b: list[str], known: frozenset[str] = frozenset()) -> bool:
    """Whether two titles' words are the same but for typing errors and abbreviations; each word counts once. Two ``known`` words are no errors for each other."""
    rest = list(b)
    left = []
    for w in a:
        if w in rest:
            rest.remove(w)
        else:
            left.append(w)
    edits = 0
    for w in left:
        fits = []
        for x in rest:
            if w in known and x in known:
                continue
            if (w.endswith(".") and x.startswith(w[:-1])) or (x.endswith(".") and w.startswith(x[:-1])):
                fits.append((0, x))
            elif (d := edit_distance(w, x, 2)) <= min(_reach(w), _reach(x)):
                fits.append((d, x))
        if not fits:
            return False
        d, x = min(fits)
        edits += d
        rest.remove(x)
    return not rest and edits <= 3


def alike_title(a: list[str], b: list[str]) -> bool:
    """Whether two titles whose dumps agree may be one: the words in all within five edits and a third of their letters."""
    x, y = (" ".join(w.rstrip(".") for w in t) for t in (a, b))
    return edit_distance(x, y, 5) <= min(5, max(len(x), len(y)) // 3) or same_title([w[:4] + "." if len(w) > 4 else w for w in a], b)


def _verify_alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = [
            p.rsplit("|", 1)[1] != q.rsplit("|", 1)[1] and (p.rsplit("|", 2)[1] == q.rsplit("|", 2)[1] or len(x) != len(y)) and alike_title(list(x), list(y))
            for p, q, x, y in zip(b["a"], b["b"], b["words_a"], b["words_b"])
        ]
        yield b.loc[keep, ["a", "b"]]


def _verify_titles(common: list[str]):
    known = frozenset(common)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [same_title(list(x), list(y), known) for x, y in zip(b["words_a"], b["words_b"])]
            yield b.loc[keep, ["a", "b"]]

    return verify


def same_publisher(x: str, y: str) -> bool:
    """Whether two telling words of publishers are one: within three edits by their length, or one the beginning of the other."""
    short = min(len(x), len(y))
    return edit_distance(x, y, 3) <= (3 if short >= 9 else 2 if short >= 5 else 0) or (short >= 4 and (x.startswith(y) or y.startswith(x)))


def _publisher_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spellings of one publisher among those of one title."""
    for b in batches:
        yield pd.DataFrame([(t, x, y) for t, names in zip(b["title"], b["names"]) for x, y in combinations(sorted(names), 2) if same_publisher(x, y)], columns=["title", "x", "y"])


def _check_publishers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.loc[[same_publisher(x, y) for x, y in zip(b["x"], b["y"])]]


def _releases(rows: DataFrame) -> DataFrame:
    """``title, publisher, release``: the spellings of each title's publishers, spellings of one publisher under one name.

    A title's few spellings are compared in one task; a title with more than MOST_SPELLINGS has them meet by segments
    and by their first four letters, so no group is collected whatever its size.
    """
    known = cut(rows.where("publisher IS NOT NULL").select("title", "publisher").distinct())
    sizes = known.groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    few = known.join(sizes.where(F.col("n") <= MOST_SPELLINGS).select("title"), "title").groupBy("title").agg(F.collect_list("publisher").alias("names"))
    edges = few.mapInPandas(_publisher_pairs, "title long, x string, y string")
    many = sizes.where(F.col("n") > MOST_SPELLINGS).select("title")
    if not many.isEmpty():
        rest = known.join(many, "title").select("title", F.col("publisher").alias("text"), F.concat_ws("|", F.col("title").cast("string"), "publisher").alias("node"))
        met = near_strings(rest.select(F.col("title").cast("string").alias("scope"), "node", "text"), rest.select(F.col("title").cast("string").alias("scope"), "node", "text"), 3)
        met = met.select(F.substring_index("node", "|", 1).cast("long").alias("title"), F.col("text").alias("x"), F.col("probe").alias("y"))
        heads = rest.where("length(text) >= 4").select("title", "text", F.substring("text", 1, 4).alias("h"))
        alike = heads.withColumnRenamed("text", "x").join(heads.withColumnRenamed("text", "y"), ["title", "h"]).select("title", "x", "y")
        edges = edges.unionByName(met.unionByName(alike).where("x < y").distinct().mapInPandas(_check_publishers, "title long, x string, y string"))
    name = F.concat_ws("|", F.col("title").cast("string"), "publisher")
    nodes = known.withColumn("name", name)
    code = string_codes(nodes, "name")
    of = lambda c: code(F.concat_ws("|", F.col("title").cast("string"), c))
    groups = connected_groups(edges.select(of("x").alias("src"), of("y").alias("dst")))
    return nodes.withColumn("code", code("name")).join(groups.withColumnRenamed("node", "code"), "code", "left").select("title", "publisher", F.coalesce("lo", "code").alias("release"))


def logistic(features: np.ndarray, right: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Coefficients of a logistic regression by Newton's method, slightly held back towards 0."""
    w = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        hessian = (features * (p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, features.T @ (right - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ReleaseIndex:
    """An inverted index of releases, ranked by BM25 over checksums and years; records are the queries.

    Terms of a release are its records' checksums and years; a term's frequency is the number of records that give it.
    The rarity of a checksum counts titles, that of a year releases. Title and publisher are not scored: all candidates
    share the title, and records that name a publisher are not ranked. A title's list of releases is never walked: releases that
    share no other term with a record score 0, or less if their years contradict it, so any TOP + 1 of them, those without
    years first, stand for the rest, and the best TOP are exact.
    """

    def __init__(self, rows: DataFrame, weights: DataFrame):
        known = rows.where("release IS NOT NULL")
        checks = known.select("title", "release", F.explode("checksums").alias("checksum")).groupBy("title", "release", "checksum").agg(F.count(F.lit(1)).alias("tf")).join(weights, "checksum")
        told = checks.groupBy("title", "release").agg(F.sum("tf").alias("told"))
        years = known.where("year > 0").groupBy("title", "release", "year").agg(F.count(F.lit(1)).alias("tf"))
        years = years.groupBy("title", "release").agg(F.map_from_entries(F.collect_list(F.struct("year", "tf"))).alias("years"))  # as many as there are years
        docs = known.groupBy("title", "release").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("checksums") + F.when(F.col("year") > 0, 1).otherwise(0) + 1).alias("len"))
        self.docs = cut(docs.join(years, ["title", "release"], "left").join(told, ["title", "release"], "left"))
        self.checks = cut(checks.join(self.docs.select("title", "release", "len"), ["title", "release"]))
        total = self.docs.agg(F.count(F.lit(1)), F.avg("len")).first()
        self.n, self.avg = total[0], float(total[1] or 1.0)
        by_year = self.docs.select(F.explode(F.map_keys("years")).alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("df")).collect()  # a few hundred years at most
        self.rarity = {r["year"]: math.log(1 + (self.n - r["df"] + 0.5) / (r["df"] + 0.5)) for r in by_year}
        self.heads = self.docs.withColumn("_k", F.row_number().over(Window.partitionBy("title").orderBy(F.col("years").isNotNull(), "release"))).where(F.col("_k") <= TOP + 1).drop("_k")

    def saturated(self, tf: Column) -> Column:
        return F.when(tf > 0, tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / self.avg))).otherwise(0.0)

    def ranked(self, queries: DataFrame) -> DataFrame:
        """The nearest release of each query (``record_id, title, year, checksums, own``): ``record_id, release, score`` and what its certainty shows in.

        ``gap`` to the next release (to none, the score itself), ``alone`` (no other release), ``tied`` (no gap to
        another), ``other_year`` (its records say years further off), ``apart`` (both have telling checksums and share
        none), ``shared`` (they share one).

        ``own`` is the release of a record whose publisher is known and hidden: what the record itself gave to that
        release does not count, and a release of it alone is none.
        """
        q = queries.select("record_id", "title", "year", "own", "sums")
        mine = F.when(F.col("release").eqNullSafe(F.col("own")), 1).otherwise(0)
        shared = queries.select("record_id", "title", "own", F.explode("checksums").alias("checksum")).distinct().join(self.checks, ["title", "checksum"])
        shared = shared.select("record_id", "title", "release", "w", "len", (F.col("tf") - mine).alias("tf")).where("tf > 0")
        dated = self.docs.select("title", "release", F.explode(F.map_keys("years")).alias("_y"))
        dated = q.where("year > 0").select("record_id", "title", F.explode(F.array(F.col("year") - 1, "year", F.col("year") + 1)).alias("_y")).join(dated, ["title", "_y"]).select("record_id", "title", "release")
        some = q.join(self.heads.select("title", "release"), "title").select("record_id", "title", "release")
        met = some.unionByName(dated).unionByName(shared.select("record_id", "title", "release"))
        met = met.unionByName(q.where("own IS NOT NULL").select("record_id", "title", F.col("own").alias("release")))
        docs = met.distinct().join(q, ["record_id", "title"]).join(self.docs, ["title", "release"]).where(F.col("n") > mine)
        sums = shared.select("record_id", "release", (F.col("w") * self.saturated(F.col("tf"))).alias("s")).groupBy("record_id", "release").agg(F.sum("s").alias("by_checksum"))
        rarity = F.create_map(*(F.lit(x) for kv in (self.rarity or {0: 0.0}).items() for x in kv))
        times = lambda d: F.coalesce(F.try_element_at("years", F.col("year") + d), F.lit(0)) - F.when(F.lit(d) == 0, mine).otherwise(0)
        given = F.coalesce(F.aggregate(F.map_values("years"), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)) - F.when(F.col("year") > 0, mine).otherwise(0)
        worth = F.coalesce(F.try_element_at(rarity, "year"), F.lit(max(self.rarity.values(), default=0.0)))
        equal, near = self.saturated(times(0)), F.greatest(self.saturated(times(-1)), self.saturated(times(1)))
        other = (F.col("year") > 0) & (given > 0) & (equal == 0) & (near == 0)
        by_year = F.when((F.col("year") == 0) | (given <= 0), 0.0).when(other, OTHER_YEAR * worth).otherwise(worth * F.greatest(equal, NEAR_YEAR * near))
        held = F.coalesce("told", F.lit(0)) - F.col("sums") * mine
        scored = docs.select("record_id", "release", "own", by_year.alias("by_year"), other.alias("other_year"), ((F.col("sums") > 0) & (held > 0)).alias("both")).join(sums, ["record_id", "release"], "left")
        scored = scored.select("record_id", "own", "release", "other_year", (F.col("both") & F.col("by_checksum").isNull()).alias("apart"), F.col("by_checksum").isNotNull().alias("shared"), (F.coalesce("by_checksum", F.lit(0.0)) + F.col("by_year")).alias("score"))
        best = Window.partitionBy("record_id").orderBy(F.col("score").desc(), "release")
        top = scored.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= TOP)
        top = top.groupBy("record_id", "own").agg(F.max_by(F.struct("release", "score", "other_year", "apart", "shared"), F.struct("score", -F.col("_k"))).alias("x"), F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
        gap = F.when(F.col("n") == 1, F.col("x.score")).otherwise(F.col("x.score") - F.col("low"))
        return top.select("record_id", "own", "x.release", "x.score", gap.alias("gap"), (F.col("n") == 1).alias("alone"), ((F.col("n") > 1) & (gap <= 0)).alias("tied"), "x.other_year", "x.apart", "x.shared")



def calibrated(ranked: DataFrame) -> Column:
    """The chance that the first release of a ranking is right, as a logistic of EVIDENCE.

    ``ranked`` holds rankings of records with a known publisher that was hidden (``own``, LABELLED at most): their
    publisher tells whether the first release is right.
    """
    got = ranked.where("own IS NOT NULL").select(*EVIDENCE, (F.col("release") == F.col("own")).alias("right")).toPandas()  # LABELLED rows
    x = np.column_stack([np.ones(len(got)), got[list(EVIDENCE)].to_numpy(dtype=float)])
    w = logistic(x, got["right"].to_numpy(dtype=float)) if len(got) >= LEAST_LABELLED else np.array(UNFITTED)
    logit = F.lit(float(w[0]))
    for name, weight in zip(EVIDENCE, w[1:]):
        logit = logit + F.lit(float(weight)) * F.col(name).cast("double")
    return 1 / (1 + F.exp(-logit))


def match_records(records: DataFrame, *, least_confidence: float = 0.5) -> DataFrame:
    """The entity of each record of several sources: ``record_id, source, entity, confidence``.

    ``records``: ``record_id, source, platform, part, title, date_text, publisher, checksums`` (array). Platform, part
    and number in a series must agree; title, publisher, checksums and year are typed, partial and noisy.

    1. Titles: distinct titles are put right against the common title words, then meet in an inverted index over the
       neighbourhood of their rare words and their forms in common words (``title_terms``). Every pair that
       ``same_title`` accepts shares a term; the common words' lists are never walked. Verified pairs form titles; so do
       titles of dumps with one telling checksum that differ somewhat more.
    2. Releases: the known publishers of a title, spellings merged, are its releases; each holds the attributes of its
       records.
    3. Each record without a publisher is a query to the inverted index of releases (``ReleaseIndex``): BM25 over
       checksums and years with exact top-k; title and publisher do not enter the score. Its confidence comes from the gap between the nearest release
       and the next, through a logistic calibrated on records whose publisher is known and hidden, and must reach
       ``least_confidence``. A checksum weighs by how few titles have it, in however many records; one that unrelated
       titles share (``FEW_TITLES``, ``ONE_TITLE``) tells nothing.
    4. The test of mutual nearness: a source describes a disc once, so a release takes of each source only the nearest
       record: one with its publisher before others, then the highest score. A shared telling checksum stands by itself.
    5. Records that no release takes are grouped among themselves by title with checksum or year.

    NULL or empty attributes tell nothing. Records whose title has no telling word stay alone, as do records without
    a platform. NULL ids are left out, repeated rows count once, no records give no rows.
    """
    parsed = cut(
        records.where("record_id IS NOT NULL").dropDuplicates(["record_id", "source"]).select("record_id", "source", F.coalesce("platform", F.lit("")).alias("platform"), "part", "title", "date_text", "publisher", "checksums")
        .mapInPandas(_parse_records, "record_id long, source string, platform string, part string, number string, words array<string>, year int, publisher string, checksums array<string>")
    )
    total = parsed.count()
    beside = parsed.select(F.filter("words", lambda w: ~w.endswith(".")).alias("words")).distinct()
    beside = beside.select(F.explode("words").alias("word"), "words").select("word", F.explode("words").alias("other")).where("word <> other").distinct()
    usual = beside.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMPANIONS)
    common = common_words({r[0]: r[1] for r in usual.orderBy(F.col("n").desc(), "word").limit(MOST_COMMON).collect()})

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fixer = WordFixer(common)
        for b in batches:
            both = [fixer.fix(list(w)) for w in b["words"]]
            fixed = [f[0] for f in both]
            number = [str(f[1]) if f[1] and n == "1" else n for f, n in zip(both, b["number"])]
            node = [f"{p}|{k}|{n}|{' '.join(w)}" for p, k, n, w in zip(b["platform"], b["part"], number, fixed)]
            yield b.assign(words=fixed, number=number, node=node)

    schema = "record_id long, source string, platform string, part string, number string, words array<string>, year int, publisher string, checksums array<string>, node string"
    rows = cut(parsed.mapInPandas(fix, schema).where(F.size("words") > 0))
    nodes = rows.select("node", "words", "platform", "part", "number").dropDuplicates(["node"])
    terms = cut(nodes.mapInPandas(_title_keys(common), "node string, term string, cut boolean, prefix boolean"))  # written once, read by both sides of both joins
    whole, short = terms.where("NOT prefix"), terms.where("prefix")
    pair = lambda x, y: x.select(F.col("node").alias("a"), "term").join(y.select(F.col("node").alias("b"), "term"), "term")
    met = pair(whole, whole).where("a < b").select("a", "b").unionByName(pair(short, short.where("cut")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    words = nodes.select("node", "words")
    near = met.join(words.select(F.col("node").alias("a"), F.col("words").alias("words_a")), "a").join(words.select(F.col("node").alias("b"), F.col("words").alias("words_b")), "b")
    edges = near.select("a", "b", "words_a", "words_b").mapInPandas(_verify_titles(common), "a string, b string")
    code = string_codes(nodes, "node")
    edges = cut(edges)
    spelled = connected_groups(edges.select(code("a").alias("src"), code("b").alias("dst"))).select(F.col("node").alias("code"), "lo")
    sums = rows.select("record_id", "node", "platform", "part", F.explode("checksums").alias("checksum")).distinct().withColumn("code", code("node"))
    sums = cut(sums.join(spelled, "code", "left").withColumn("spelled", F.coalesce("lo", "code")).drop("code", "lo"))
    holders = sums.groupBy("checksum", "spelled").agg(F.count(F.lit(1)).alias("n"))
    holders = holders.groupBy("checksum").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("n"), F.max(F.struct("n", "spelled")).alias("most"))
    telling = cut(holders.where((F.col("df") <= FEW_TITLES) | (F.col("most.n") >= ONE_TITLE * F.col("n"))).select("checksum", F.log(1 + F.lit(float(total)) / F.col("df")).alias("w"), F.col("most.spelled").alias("main")))
    weights = telling.select("checksum", "w")
    shared = sums.join(telling.select("checksum", "main"), "checksum").select("node", "platform", "part", "checksum", "spelled", "main").distinct()
    other = shared.where("spelled <> main")  # the spellings of a title are one already, so only the others of each checksum look for theirs
    same = ["platform", "part", "checksum"]
    met = other.select(*same, F.col("node").alias("a"), F.col("spelled").alias("s")).join(shared.select(*same, F.col("node").alias("b"), F.col("spelled").alias("t")), same).where("s <> t").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = met.join(words.select(F.col("node").alias("a"), F.col("words").alias("words_a")), "a").join(words.select(F.col("node").alias("b"), F.col("words").alias("words_b")), "b")
    edges = edges.unionByName(near.select("a", "b", "words_a", "words_b").mapInPandas(_verify_alike, "a string, b string"))
    titles = connected_groups(edges.select(code("a").alias("src"), code("b").alias("dst"))).withColumnRenamed("node", "code")
    rows = rows.withColumn("code", code("node")).join(titles, "code", "left").select("record_id", "source", F.coalesce("lo", "code").alias("title"), "year", F.nullif("publisher", F.lit("")).alias("publisher"), "checksums")
    rows = cut(rows)

    rows = rows.join(_releases(rows), ["title", "publisher"], "left")
    checks = rows.select("record_id", F.explode("checksums").alias("checksum")).distinct().join(weights.select("checksum"), "checksum")
    rows = cut(rows.join(checks.groupBy("record_id").agg(F.count(F.lit(1)).alias("sums")), "record_id", "left").withColumn("sums", F.coalesce("sums", F.lit(0))))
    releases = rows.where("release IS NOT NULL").select("title").distinct().withColumn("known", F.lit(True))
    index = ReleaseIndex(rows, weights)
    columns = ["record_id", "title", "year", "checksums", "sums"]
    hidden = rows.where("release IS NOT NULL").orderBy(F.xxhash64("record_id", "source"), "record_id").limit(LABELLED).select(*columns, F.col("release").alias("own"))  # spread over all by a hash of their ids
    ranked = cut(index.ranked(hidden.unionByName(rows.where("release IS NULL").select(*columns, F.lit(None).cast("long").alias("own")))))
    taken = ranked.where("own IS NULL").withColumn("confidence", calibrated(ranked)).where(F.col("confidence") >= least_confidence).select("record_id", F.col("release").alias("to"), "confidence", "score", "shared")
    offered = rows.join(taken, "record_id", "left").withColumn("offer", F.coalesce("release", "to")).withColumn("from", F.coalesce("source", F.lit("")))
    nearest = offered.where("offer IS NOT NULL").groupBy("title", "offer", "from").agg(F.count("release").alias("_own"), F.max("score").alias("_top"))
    mutual = F.col("release").isNotNull() | F.col("shared") | ((F.col("_own") == 0) & (F.col("score") >= F.col("_top")))
    judged = offered.join(nearest, ["title", "offer", "from"], "left")
    rows = cut(judged.select("record_id", "source", "title", "year", "publisher", "checksums", F.when(mutual, F.col("offer")).alias("release"), F.coalesce(F.when(F.col("publisher").isNotNull(), 1.0), "confidence").alias("confidence")))

    rest = rows.where("release IS NULL")
    spread = rest.groupBy("title").agg(F.min(F.when(F.col("year") > 0, F.col("year"))).alias("first"), F.max("year").alias("last"))
    spread = spread.join(releases, "title", "left").withColumn("one", F.col("known").isNull() & (F.col("first").isNull() | (F.col("last") - F.col("first") <= 1)))
    rest = rest.join(spread.select("title", "one"), "title")
    hub = lambda *c: F.xxhash64(F.lit("hub"), *c)
    own = F.xxhash64(F.lit("record"), "record_id")
    links = (
        rest.where("one").select(own.alias("src"), hub(F.lit("title"), "title").alias("dst"))
        .unionByName(rest.where("NOT one AND year > 0").select(own.alias("src"), hub(F.lit("year"), "title", "year").alias("dst")))
        .unionByName(rest.where("NOT one").select("record_id", "title").join(checks, "record_id").select(own.alias("src"), hub(F.lit("sum"), "title", "checksum").alias("dst")))
    )
    groups = connected_groups(links)
    rest = rest.withColumn("own", own).join(groups.withColumnRenamed("node", "own"), "own", "left").select("record_id", "source", F.coalesce("lo", "own").alias("entity"), F.lit(0.5).alias("confidence"))
    sure = rows.where("release IS NOT NULL").select("record_id", "source", F.xxhash64("title", "release").alias("entity"), "confidence")
    return sure.unionByName(rest)


def cross_source_pairs(records: DataFrame, **parameters) -> DataFrame:
    """Every two records of different sources that describe one entity: ``record_a, record_b, confidence``, the smaller id first.

    The result needs every pair, so it grows with the records of one entity in different sources, not with anything
    that only looks alike. The confidence of a pair is that of its less certain record.
    """
    found = cut(match_records(records, **parameters))
    a = found.select("entity", F.col("record_id").alias("record_a"), F.col("source").alias("s"), F.col("confidence").alias("c"))
    b = found.select("entity", F.col("record_id").alias("record_b"), F.col("source").alias("t"), F.col("confidence").alias("d"))
    pairs = a.join(b, "entity").where((F.col("record_a") < F.col("record_b")) & ~F.col("s").eqNullSafe(F.col("t")))
    return pairs.groupBy("record_a", "record_b").agg(F.max(F.least("c", "d")).alias("confidence"))


def unseried_discs(discs: DataFrame, contents: DataFrame, images: DataFrame) -> DataFrame:
    """The records of discs without a series with the publisher of their first title and their dumps' checksums, for ``match_records``."""
    own = discs.where("series_key = ''").select("record_id", "source", "platform", "part", "title", "date_text")
    titles = contents.where("record_id IS NOT NULL").groupBy("record_id").agg(F.min_by("publisher", F.struct(F.coalesce("pos", F.lit(2**31 - 1)), "content_id")).alias("publisher"))
    sums = images.where("record_id IS NOT NULL AND crc32 IS NOT NULL").groupBy("record_id").agg(F.collect_set("crc32").alias("checksums"))
    return own.join(titles, "record_id", "left").join(sums, "record_id", "left")
