"""Ranked full-text search: an inverted index over several text columns, boolean word queries and bm25."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diskloom.functions.names import words_of

#: The two bm25 parameters, and what an inverse document frequency of zero or less counts as.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Phrase:
    """One word of a query: a whole token, or the start of one."""

    word: str
    prefix: bool

    def holds(self, token: Column) -> Column:
        return token.startswith(self.word) if self.prefix else token == self.word


@dataclass(frozen=True)
class Expression:
    """A boolean expression over phrases: ``kind`` is "phrase", "and" or "or"."""

    kind: str
    phrase: Phrase | None = None
    parts: tuple[Expression, ...] = ()

    def phrases(self) -> list[Phrase]:
        found = [self.phrase] if self.phrase else [p for x in self.parts for p in x.phrases()]
        return list(dict.fromkeys(found))

    def holds(self, has: Mapping[Phrase, Column]) -> Column:
        if self.phrase:
            return has[self.phrase]
        out = self.parts[0].holds(has)
        for part in self.parts[1:]:
            out = out & part.holds(has) if self.kind == "and" else out | part.holds(has)
        return out

    def counted(self, has: Mapping[Phrase, Column], given: Column | None = None) -> list[tuple[Phrase, Column | None]]:
        """Every phrase with the condition under which it scores: that each "or" branch above it holds."""
        if self.phrase:
            return [(self.phrase, given)]
        out = []
        for part in self.parts:
            under = given
            if self.kind == "or":
                here = part.holds(has)
                under = here if given is None else given & here
            out += part.counted(has, under)
        return out


def split_word(word: str) -> list[str]:
    """The parts of a word with a number in or beside it: "zorbo2" gives zorbo and 2; else the word itself."""


    if m := re.fullmatch(r"([^\W\d_]+)(\d+)([^\W\d_]?)", word):
        return [g for g in m.groups() if g]
    if m := re.fullmatch(r"(\d+)([^\W\d_])", word):
        return list(m.groups())
    return [word]


def word_query(words: Sequence[str]) -> Expression | None:
    """Rows must have every word. A word of one sign or a number must match whole, others the start of a token; a word with
    a number in it also matches as its parts.
    """
    parts = []
    for word in (w for w in words if w):
        own = Expression("phrase", Phrase(word, not (len(word) == 1 or word.isdigit())))
        pieces = split_word(word)
        parts.append(Expression("or", parts=(own, word_query(pieces))) if len(pieces) > 1 else own)
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else Expression("and", parts=tuple(parts))


@dataclass(frozen=True)
class TextIndex:
    """``postings``: id, field, token, tf, len (tokens of the row over all fields); ``rows`` and ``mean_len`` of the whole index."""

    postings: DataFrame
    rows: int
    mean_len: float
    weights: Mapping[str, float]


def build_postings(rows: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """Postings of text columns whose words are set apart by single spaces.

    Tokens are counted per row and field on the map side; rows without any token are not in the postings. NULL counts
    as ''.
    """
    texts = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("text")) for f in fields))
    lengths = sum((F.size(words_of(F.coalesce(F.col(f), F.lit("")))) for f in fields), F.lit(0))
    long = rows.select(F.col(id_col).alias("id"), lengths.alias("len"), F.explode(texts).alias("t"))
    return long.select("id", "len", "t.field", F.explode(words_of(F.col("t.text"))).alias("token")).groupBy("id", "field", "token").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("len").alias("len"))


def text_index(rows: DataFrame, id_col: str, fields: Mapping[str, float], postings: DataFrame | None = None) -> TextIndex:
    """An index over ``rows`` with a bm25 weight for each field; ``postings`` may be given as written by a snapshot."""
    postings = build_postings(rows, id_col, list(fields)) if postings is None else postings
    total = rows.count()
    tokens = postings.agg(F.sum("tf")).first()[0] or 0
    return TextIndex(postings, total, tokens / total if total else 0.0, dict(fields))


def matching(index: TextIndex, query: Expression, fields: Sequence[str] | None = None) -> DataFrame:
    """Rows for which ``query`` holds within ``fields`` (all if none are given): ``id, len`` and the weighted frequency ``f<i>`` of each phrase.

    One filtered scan of the postings (the words reach the scan as predicates) and one aggregation by row.
    """
    phrases = query.phrases()
    token = F.col("token")
    postings = index.postings if fields is None else index.postings.where(F.col("field").isin(list(fields)))
    wanted = phrases[0].holds(token)
    for p in phrases[1:]:
        wanted = wanted | p.holds(token)
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in index.weights.items() for x in kv)), F.col("field"))
    found = postings.where(wanted).groupBy("id").agg(F.first("len").alias("len"), *(F.sum(F.when(p.holds(token), weight * F.col("tf")).otherwise(0.0)).alias(f"f{i}") for i, p in enumerate(phrases)))
    return found


def ranked(index: TextIndex, query: Expression, fields: Sequence[str] | None = None) -> DataFrame:
    """``id, rank`` of the rows for which ``query`` holds; ``rank`` is bm25, the lower the better (as negative numbers).

    A phrase's rarity counts the rows that match it within ``fields``. Phrases of an "or" score only where their branch
    holds.
    """
    found = matching(index, query, fields)
    phrases = query.phrases()
    has = {p: F.col(f"f{i}") > 0 for i, p in enumerate(phrases)}
    counts = found.agg(*(F.count_if(has[p]).alias(f"n{i}") for i, p in enumerate(phrases))).first()
    score = F.lit(0.0)
    for p, given in query.counted(has):
        i = phrases.index(p)
        n = counts[i]
        idf = math.log((index.rows - n + 0.5) / (n + 0.5))
        f = F.col(f"f{i}")
        part = F.lit(idf if idf > 0 else LEAST_IDF) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(index.mean_len or 1.0)))
        score = score + (part if given is None else F.when(given, part).otherwise(0.0))
    return found.where(query.holds(has)).select("id", (-score).alias("rank"))


def matched_ids(index: TextIndex, query: Expression, fields: Sequence[str] | None = None) -> DataFrame:
    """``id`` of the rows for which ``query`` holds, without ranking."""
    has = {p: F.col(f"f{i}") > 0 for i, p in enumerate(query.phrases())}
    return matching(index, query, fields).where(query.holds(has)).select("id")


def word_matches(word: str, words: Column) -> Column:
    """Whether a query word matches one of an array of words, by the same rule as ``word_query``."""
    own = Phrase(word, not (len(word) == 1 or word.isdigit()))
    out = F.exists(words, lambda w: own.holds(w))
    pieces = split_word(word)
    if len(pieces) > 1:
        both = word_matches(pieces[0], words)
        for piece in pieces[1:]:
            both = both & word_matches(piece, words)
        out = out | both
    return out
