"""Pages made for search engines: stuffed with search words, links, tags or offers instead of sentences."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diskloom.functions.text import plain

#: Share of a page's characters in stuffed units from which it is spam, and the characters of it there must be.
LEAST_SHARE, LEAST_CHARS = 0.5, 40
#: A repeated substring is dense if it occurs once in so many tokens of the page, and DENSE_TIMES at least.
DENSE_GAP, DENSE_TIMES = 60, 3
#: So many different words, said over and over, are a refrain.
REFRAIN_WORDS = 5
#: Tokens of a page from which coverage is read off a suffix array in place of an automaton: the same result in bounded memory.
LONG_PAGE = 200_000
# Last parts of host names that are as short as the endings of file names; longer ones count in general.
_SHORT_DOMAINS = "com net org info biz edu gov eu de uk nl fr it es ch at be se no dk fi pl cz us ca au jp br in io co me tv shop site".split()
_LINK = re.compile(
    r"<a\b[^<>]*>.*?</a>|\[[^\[\]\n]{0,200}\]\([^()\s]{3,300}\)|\b[a-z][a-z0-9+.-]{1,9}://\S+|\bwww\.\S+|(?<![\w@&/])#[a-z][\w-]{4,}"
    rf"|(?<![\w@.-])(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?:[a-z]{{5,18}}|{'|'.join(_SHORT_DOMAINS)})\b(?:/\S*)?",
    re.I | re.S,
)
_LINK_MARKS = ("://", "www.", "WWW.", "#", "<a", "<A", "](")
_DOMAIN = re.compile(rf"[a-z0-9]\.(?:[a-z]{{5,18}}|{'|'.join(_SHORT_DOMAINS)})\b", re.I)
_PRICE = re.compile(r"(?:\b(?:eur|usd|gbp|dm)\b|(?<![#\w])[€$£])\s*\d+(?:[.,]\d\d)?(?!\w)|\d+[.,]\d\d\s*(?:\b(?:eur|usd|gbp|dm)\b|[€$£])", re.I)
_TOKEN = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_CLAUSE_END = re.compile(r"(?<=[.!?])\s+")
_PAUSE = re.compile(r"[.,;:!?|()\"\t/*#=<>\[\]-]+\s*|\n")
_SEPARATOR = re.compile(r"[,;|/•·\t]+|\s[-–*>]+\s|\s{2,}|[.!?](?:\s|$)")


def _covered(reach: list[int]) -> list[bool]:
    """Whether each token lies in one of the substrings of ``reach`` tokens (0 for none) that end at the tokens."""
    out = [False] * len(reach)
    left = len(reach)
    for i in range(len(reach) - 1, -1, -1):
        left = min(left, i - reach[i] + 1)
        if left <= i:
            out[i] = True
        if left == i:
            left = len(reach)
    return out


def repeated_in_long(tokens: list[str], *least: float) -> list[list[bool]]:
    """``repeated`` by a suffix array (prefix doubling) with its longest common prefixes, for pages too long for an automaton."""
    n = len(tokens)
    rank = np.unique(np.asarray(tokens, dtype=object), return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.full(n, -1, dtype=np.int64)
        second[: n - step] = rank[step:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.zeros(n, dtype=np.int64)
        new[order[1:]] = np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        rank, step = new, step * 2
        if step >= n or rank.max() == n - 1:
            break
    place, sa, common = rank.tolist(), order.tolist(), [0] * n
    h = 0
    for i in range(n):
        if place[i]:
            j = sa[place[i] - 1]
            while i + h < n and j + h < n and tokens[i + h] == tokens[j + h]:
                h += 1
            common[place[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    out = []
    for k in (int(np.ceil(x)) for x in least):
        # the longest beginning that k neighbouring suffixes share, best over the groups of k that a suffix is in
        low = pd.Series(common[1:], dtype="int64").rolling(k - 1).min().dropna().to_numpy() if n >= k else np.empty(0)
        best = pd.Series(np.concatenate([np.zeros(k - 1), low, np.zeros(k - 1)])).rolling(k).max().dropna().to_numpy() if len(low) else np.zeros(n)
        length = np.zeros(n, dtype=np.int64)
        length[order] = best[:n].astype(np.int64)
        length[length < 2] = 0
        ends = np.maximum.accumulate(np.arange(n) + length)
        out.append((ends > np.arange(n)).tolist())
    return out


def repeated(tokens: list[str], *least: float) -> list[list[bool]]:
    """For each number of ``least``: whether each token lies in a substring of two or more tokens that occurs so often in the list.

    A suffix automaton of the list is built in one pass. Its states are the maximal repeated substrings with their
    numbers of occurrences; from each end, the longest one that occurs often enough covers its tokens. A token that
    occurs once lies in no repeated substring: the automaton starts anew behind it, as for a further string.
    """
    if len(tokens) >= LONG_PAGE:
        return repeated_in_long(tokens, *least)
    times = Counter(tokens)
    arcs: list[dict[str, int]] = [{}]
    link, length, count = [-1], [0], [0]
    last, ends = 0, []
    for t in tokens:
        if times[t] == 1:
            last = 0
            ends.append(0)
            continue
        if (q := arcs[last].get(t)) is not None and length[last] + 1 == length[q]:
            count[q] += 1
            last = q
            ends.append(q)
            continue
        p = last
        if q is None:
            new = len(arcs)
            arcs.append({})
            link.append(0)
            length.append(length[last] + 1)
            count.append(1)
            while p != -1 and t not in arcs[p]:
                arcs[p][t] = new
                p = link[p]
            last = new
            if p == -1:
                ends.append(new)
                continue
            q = arcs[p][t]
            if length[p] + 1 == length[q]:
                link[new] = q
                ends.append(new)
                continue
        else:
            new = -1
        clone = len(arcs)
        arcs.append(arcs[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        count.append(0)
        while p != -1 and arcs[p].get(t) == q:
            arcs[p][t] = clone
            p = link[p]
        link[q] = clone
        if new >= 0:
            link[new] = clone
        else:
            count[clone] += 1
            last = clone
        ends.append(last)
    for v in sorted(range(1, len(arcs)), key=length.__getitem__, reverse=True):
        if link[v] > 0:
            count[link[v]] += count[v]
    out = []
    for often in least:
        reach: list[int] = []  # of each state the length of the longest suffix that occurs so often, found once
        for v in range(len(arcs)):
            u = v
            while u > 0 and count[u] < often:
                u = link[u]
            reach.append(length[u] if u > 0 and length[u] >= 2 else 0)
        out.append(_covered([reach[e] for e in ends]))
    return out


def units(text: str, linked: bool) -> Iterator[str]:
    """The lines of a text; long ones without links (there are none unless ``linked``) fall into sentences."""
    for line in text.split("\n"):
        line = line.strip()
        if len(line) > 120 and not (linked and _LINK.search(line)):
            yield from filter(None, (u.strip() for u in _CLAUSE_END.split(line)))
        elif line:
            yield line


def _edges(parts: list[str], listed: list[bool]) -> tuple[list[list[list[str]]], Counter, Counter]:
    """The pieces (words of letters between separators) of units without an end of a sentence, and how many pieces begin and end with each word."""
    pieces = [[w for w in (_LETTERS.findall(x.lower()) for x in _SEPARATOR.split(u)) if w] if own else [] for u, own in zip(parts, listed)]
    long = [w for q in pieces for w in q if len(w) > 1]
    return pieces, Counter(w[0] for w in long), Counter(w[-1] for w in long)


def stuffing(text: str) -> tuple[float, float, int]:
    """Share of the characters of a text in stuffed units, share in repeated substrings, and characters in stuffed units.

    Coverage by repeated maximal substrings decides together with missing clauses, without any list of words. A unit
    (a line, or a sentence of a long one) is stuffed

    - if dense repeated substrings (DENSE_GAP) cover it and a fifth of its words or more are said twice in it: a clause
      says something besides the phrase that the page repeats;
    - if it is a long stretch without pause that repeated substrings cover (of these two the page must say more than a
      refrain: REFRAIN_WORDS different words or fewer are a chant, not search words);
    - if it names a price, has no end of a sentence, and half of what it says is repeated on the page;
    - if it is a list of pieces of which most begin or end with words that do so again and again: the page's search
      words around names that differ;
    - if most of it is links or tags, which hold no clause at all.
    """
    page = plain(text)
    linked = any(mark in page for mark in _LINK_MARKS) or _DOMAIN.search(page) is not None
    priced = _PRICE.search(page) is not None
    parts = list(units(page, linked))
    tokens: list[str] = []
    spans = []
    for u in parts:
        words = _TOKEN.findall(u.lower())
        spans.append((len(tokens), len(tokens) + len(words)))
        tokens += words
    again, dense = repeated(tokens, 2, max(DENSE_TIMES, len(tokens) / DENSE_GAP))
    upto, dense_upto = [0, *accumulate(again)], [0, *accumulate(dense)]
    open_ended = [u[-1] not in ".!?" for u in parts]
    pieces, first, last = _edges(parts, [o and b - a >= 12 for o, (a, b) in zip(open_ended, spans)])
    total = stuffed = dense_chars = 0
    said: set[str] = set()
    for u, (a, b), own, listed in zip(parts, spans, open_ended, pieces):
        n = max(1, b - a)
        repeats, thick = (upto[b] - upto[a]) / n, (dense_upto[b] - dense_upto[a]) / n
        total += len(u)
        if (
            (linked and sum(len(m[0]) for m in _LINK.finditer(u)) >= 0.6 * len(u))
            or (priced and own and repeats >= 0.35 and _PRICE.search(u))
            or _framed(listed, first, last)
        ):
            stuffed += len(u)
        elif (thick >= 0.4 and n >= 3 and len(set(tokens[a:b])) < 0.8 * n) or (
            repeats >= 0.75 and n >= 15 and len(set(tokens[a:b])) < 0.5 * n and max(len(_TOKEN.findall(x)) for x in _PAUSE.split(u)) >= 15
        ):
            dense_chars += len(u)
            said.update(tokens[a:b])
    if len(said) > REFRAIN_WORDS:
        stuffed += dense_chars
    letters = sum(map(len, tokens))
    return stuffed / max(1, total), sum(len(w) for w, r in zip(tokens, again) if r) / max(1, letters), stuffed


def _framed(pieces: list[list[str]], first: Counter, last: Counter) -> bool:
    """Whether six pieces or more are mostly framed by words that frame others (and half of them differ): 0.8 of them, or 0.7 by three different words."""
    if len(pieces) < 6 or sum(map(len, pieces)) > 7 * len(pieces) or 2 * len(set(map(tuple, pieces))) < len(pieces):
        return False
    heads = [w[0] if len(w) > 1 and first[w[0]] >= 2 else "" for w in pieces]
    tails = [w[-1] if len(w) > 1 and last[w[-1]] >= 2 else "" for w in pieces]
    share = sum(1 for h, t in zip(heads, tails) if h or t) / len(pieces)
    return share >= 0.8 or (share >= 0.7 and len({h for h in heads if h}) + len({t for t in tails if t}) >= 3)


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [stuffing(t) for t in b["text"]]
        yield pd.DataFrame({"doc_id": b["doc_id"], "stuffed_share": [r[0] for r in rows], "repeated_share": [r[1] for r in rows], "stuffed_chars": [r[2] for r in rows]})


def stuffing_scores(documents: DataFrame) -> DataFrame:
    """``doc_id, stuffed_share, repeated_share, stuffed_chars`` of each document with a text (see ``stuffing``); needs no shuffle.

    NULL ids and NULL texts have no row; an empty or blank text scores 0. Whole texts are measured.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInPandas(_score, "doc_id long, stuffed_share double, repeated_share double, stuffed_chars long")


def stuffed_pages(documents: DataFrame, *, least_share: float = LEAST_SHARE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id`` of each document of which more than ``least_share`` (and ``least_chars``) is stuffing; repeated rows give one row."""
    return stuffing_scores(documents).where((F.col("stuffed_share") > least_share) & (F.col("stuffed_chars") >= least_chars)).select("doc_id").distinct()
