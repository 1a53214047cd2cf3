"""Evaluation texts that leak, fully or partly, into training documents."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diskloom.functions.text import plain
from diskloom.session import cut

#: Characters of documents that one suffix array covers, and of evaluation texts that one pass over the documents looks for.
SHARD_CHARS, BLOCK_CHARS = 8_000_000, 8_000_000
#: Words of a passage that counts towards the share held.
PASSAGE_WORDS = 3
#: Share of an item's words that passages must cover.
LEAST_SHARE = 0.5
_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,300}>")
_BREAK = re.compile(r"(?<=[^\W\d_])-[ \t]*\n[ \t>]*(?=[^\W\d_])")
_WORD = re.compile(r"[a-z0-9]+")
FOUND = "doc_id long, item_id long, share double, passages array<struct<doc_word:int,item_word:int,words:int>>"


def leak_words(text: str) -> list[str]:
    """The words of a text without regard to layout, markup, letter forms and case."""
    return _WORD.findall(plain(_TAG.sub(" ", _BREAK.sub("", text))).lower())


class _Heads:
    """The starts of ``width`` words of all suffixes of some items, numbered in two steps so that a vocabulary of any size fits 64 bits."""

    def __init__(self, width: int, items: list[tuple[int, np.ndarray]], words: int):
        self.width, self.base = width, words + 1
        place = np.concatenate([np.arange(len(w) - width + 1) for _, w in items])
        owner = np.concatenate([np.full(len(w) - width + 1, i) for i, w in items])
        flat = np.concatenate([np.append(w, np.zeros(width, dtype=np.int64)) for _, w in items])
        starts = np.cumsum([0] + [len(w) + width for _, w in items])[:-1]
        at = np.concatenate([s + np.arange(len(w) - width + 1) for s, (_, w) in zip(starts, items)])
        self.steps: list[np.ndarray] = []
        key = flat[at]
        for k in range(1, width):
            known = np.unique(key)
            self.steps.append(known)
            key = np.searchsorted(known, key) * self.base + flat[at + k]
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.bounds = np.append(first, len(key))
        self.owner, self.place = owner[order], place[order]

    def of(self, flat: np.ndarray) -> np.ndarray:
        """The number of the head at each position of a text, -1 where no item has these words."""
        n = len(flat) - self.width + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        key = flat[:n].copy()
        for k, known in enumerate(self.steps, 1):
            i = np.minimum(np.searchsorted(known, key), len(known) - 1)
            key = np.where((key > 0) & (known[i] == key) & (flat[k : k + n] > 0), i * self.base + flat[k : k + n], -1)
        return np.where(key > 0, key, -1)


class ItemIndex:
    """The words of evaluation items as numbers; all their suffixes are looked up in the suffix array of a shard."""

    def __init__(self, items: list[tuple[int, str]], seed_words: int = PASSAGE_WORDS):
        self.numbers: dict[str, int] = {}
        self.items: dict[int, list[int]] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in leak_words(text)]
            if words:
                self.items[item] = words
        self.ids = list(self.items)
        by_width: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for i, item in enumerate(self.ids):
            by_width[min(seed_words, len(self.items[item]))].append((i, np.asarray(self.items[item], dtype=np.int64)))
        self.heads = [_Heads(w, owned, len(self.numbers)) for w, owned in sorted(by_width.items())]

    def passages(self, documents: list[tuple[int, list[int]]]) -> np.ndarray:
        """All longest verbatim matches of ``seed_words`` words or more (fewer for shorter items): rows (document's place, item's place, word of the document, word of the item, words), sorted.

        The shard's words lie in one array. The positions at which a head of an item stands, sorted by their words, are
        the part of its suffix array that can match (kept as whole numbers, so its size does not depend on how long
        items are); each distinct start of an item's suffix is found in it by binary search. Matches that go on
        diagonally are one longer match.
        """
        sizes = np.array([len(w) for _, w in documents], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] if len(sizes) else np.empty(0, dtype=np.int64)
        flat = np.zeros(int(sizes.sum() + len(sizes)), dtype=np.int64)
        for s, (_, w) in zip(starts.tolist(), documents):
            flat[s : s + len(w)] = w
        out = []
        for heads in self.heads:
            key = heads.of(flat)
            at = np.flatnonzero(key >= 0)
            array = at[np.argsort(key[at], kind="stable")]
            sorted_keys = key[array]
            low, high = np.searchsorted(sorted_keys, heads.keys, "left"), np.searchsorted(sorted_keys, heads.keys, "right")
            hits, own = high - low, np.diff(heads.bounds)
            met = np.flatnonzero(hits)
            if not len(met):
                continue
            each = hits[met] * own[met]  # every position of a head with every item's suffix that begins so
            head = np.repeat(met, each)
            nth = np.arange(len(head)) - np.repeat(np.cumsum(each) - each, each)
            p = array[low[head] + nth // own[head]]
            o = heads.bounds[head] + nth % own[head]
            item, j = heads.owner[o], heads.place[o]
            order = np.lexsort((p, p - j, item))
            p, j, item = p[order], j[order], item[order]
            new = np.ones(len(p), dtype=bool)
            new[1:] = (item[1:] != item[:-1]) | (p[1:] - j[1:] != p[:-1] - j[:-1]) | (p[1:] != p[:-1] + 1)
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(p))) + heads.width - 1
            place = np.searchsorted(starts, p[first], "right") - 1
            out.append(np.column_stack([place, item[first], p[first] - starts[place], j[first], n]))
        found = np.concatenate(out) if out else np.empty((0, 5), dtype=np.int64)
        return found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]

    def candidates(self, documents: list[tuple[int, list[int]]]) -> dict[tuple[int, int], set[int]]:
        """Words of each item that lie in passages of a document: {(document's place, item): places in the item}."""
        met: dict[tuple[int, int], set[int]] = defaultdict(set)
        for place, i, _, j, n in self.passages(documents).tolist():
            met[place, self.ids[i]].update(range(j, j + n))
        return met

    def leaks(self, documents: list[tuple[int, list[int]]], least_share: float) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
        """(document's place, item, share, passages) of each item of which a document's passages, in the item's order, hold the share."""
        found = self.passages(documents)
        if not len(found):
            return
        pair = found[:, 0] * len(self.ids) + found[:, 1]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        most = np.add.reduceat(found[:, 4], first)  # overlapping passages count twice here, so no pair is missed
        sizes = np.array([len(self.items[i]) for i in self.ids])[found[first, 1]]
        ends = np.append(first[1:], len(found))
        for k in np.flatnonzero(most >= least_share * sizes).tolist():
            share, chain = chained(found[first[k] : ends[k], 2:])
            share /= int(sizes[k])
            if share >= least_share:
                yield int(found[first[k], 0]), self.ids[int(found[first[k], 1])], share, chain


def chained(passages: np.ndarray) -> tuple[int, list[tuple[int, int, int]]]:
    """The most words of an item that passages (rows: word of the document, word of the item, words; sorted) cover in the item's order, and the passages that do so."""
    p, j, n = passages[:, 0], passages[:, 1], passages[:, 2]
    best, before = n.astype(np.int64), np.full(len(n), -1)
    for k in range(1, len(n)):
        gain = best[:k] + n[k] - np.maximum(0, np.maximum(p[:k] + n[:k] - p[k], j[:k] + n[:k] - j[k]))
        gain[(p[:k] >= p[k]) | (j[:k] >= j[k]) | (gain <= best[:k])] = 0
        m = int(gain.argmax())
        if gain[m] > best[k]:
            best[k], before[k] = gain[m], m
    k = int(best.argmax())
    top, chain = int(best[k]), []
    while k >= 0:
        chain.append((int(p[k]), int(j[k]), int(n[k])))
        k = int(before[k])
    return top, chain[::-1]


def _leaks(items: list[tuple[int, str]], least_share: float):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = ItemIndex(items)
        numbers = index.numbers

        def found(shard: list[tuple[int, list[int]]]) -> pd.DataFrame:
            rows = [(shard[place][0], item, share, [dict(zip(("doc_word", "item_word", "words"), x)) for x in chain]) for place, item, share, chain in index.leaks(shard, least_share)]
            return pd.DataFrame(rows, columns=["doc_id", "item_id", "share", "passages"]).astype({"doc_id": "int64", "item_id": "int64", "share": "float64"})

        shard: list[tuple[int, list[int]]] = []
        size = 0
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"]):
                shard.append((doc, [numbers.get(w, 0) for w in leak_words(text)]))
                size += len(text)
                if size >= SHARD_CHARS:
                    yield found(shard)
                    shard, size = [], 0
        if shard:
            yield found(shard)

    return scan


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK_CHARS characters (a single longer item is a block of its own)."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.toLocalIterator():
        if block and size + len(row[1]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def leaked_items(documents: DataFrame, items: DataFrame, *, least_share: float = LEAST_SHARE) -> DataFrame:
    """Each document that holds ``least_share`` or more of an item's words in the item's order: ``doc_id, item_id, share, passages``.

    Documents are cut into shards of about SHARD_CHARS characters as they stream through a task; each shard gets a
    suffix array of its words, in which all suffixes of all items are looked up by binary search. Verbatim passages of
    PASSAGE_WORDS or more, chained in the item's order, must make up the share; ``passages`` gives their places, counted
    in words, in the document and in the item. Layout, markup, entities, damaged encodings, letter forms, accents and
    case make no difference. The documents are read once for each block of BLOCK_CHARS of items and never shuffled;
    only found pairs are. The driver holds one block of items at a time: with several, each block's pairs are written
    to the shared folder before the next is fetched.

    Whole texts are scanned. NULL, empty and wordless texts and items are never part of a leak; repeated rows give one
    row, of different texts under one id the largest share counts. Empty tables give no rows.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    known = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    parts: list[DataFrame] = []
    before = None
    for block in _blocks(known):
        if before is not None:
            parts.append(cut(texts.mapInPandas(_leaks(before, least_share), FOUND)))
        before = block
    if before is None:
        return documents.sparkSession.createDataFrame([], FOUND)
    last = texts.mapInPandas(_leaks(before, least_share), FOUND)
    rows = reduce(DataFrame.unionByName, parts, last).groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "passages")).alias("x"))
    return rows.select("doc_id", "item_id", "x.share", "x.passages")


def without_leaks(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """``documents`` without the rows whose ``doc_id`` leaks an item; rows without an id stay."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
