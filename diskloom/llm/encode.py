"""Encoding of whole corpora with a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the public tokenizers' files; a parameter of the operator, the files are never copied.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Fixed value: how the public byte-level vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments whose ids a task remembers; beyond it the memory starts anew. Fragments longer than LONGEST_KEPT bytes are not remembered.
MOST_KEPT, LONGEST_KEPT = 400_000, 64


class FragmentEncoder:
    """Encodes texts by cutting them where no token can reach across.

    A byte pair that occurs inside no token of the vocabulary can never be merged, so a token boundary is certain
    between such bytes. Texts are cut there, unless the cut could change how the pattern splits the text: never after
    white space (whose run looks at what follows), never before an apostrophe (that may open a contraction), never
    beside a byte of a longer character on the left, and never inside a character. Fragments are encoded on their own,
    each distinct one once, and their ids are concatenated: the result equals encoding the whole text.
    """

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            if len(token) > 1:
                b = np.frombuffer(token, dtype=np.uint8)
                inside[b[:-1], b[1:]] = True
        cut = ~inside
        cut[128:, :] = False  # the left character may be white space of several bytes
        cut[:, 128:192] = False  # inside a character
        cut[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32], :] = False
        cut[:, ord("'")] = False
        self.cut = cut
        self.known: dict[bytes, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        data = text.encode()
        if not data:
            return []
        b = np.frombuffer(data, dtype=np.uint8)
        at = (np.flatnonzero(self.cut[b[:-1], b[1:]]) + 1).tolist()
        known, ids, start = self.known, [], 0
        at.append(len(data))
        for end in at:
            fragment = data[start:end]
            start = end
            found = known.get(fragment)
            if found is None:
                found = self.encoding.encode_ordinary(fragment.decode())
                if len(fragment) <= LONGEST_KEPT:
                    if len(known) >= MOST_KEPT:
                        known.clear()
                    known[fragment] = found
            ids += found
        return ids


@lru_cache(maxsize=4)
def _encoder(path: str) -> FragmentEncoder:
    return FragmentEncoder(path)


def encode_corpus(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The ids of every text by a public tokenizer, without special tokens: ``doc_id, ids`` (array<int>).

    One row for every row of ``documents``, whole texts; an empty or NULL text gives an empty list, and strings that
    look like special tokens are ordinary text. Needs no shuffle: each task cuts its texts into fragments (see
    ``FragmentEncoder``) and encodes each distinct fragment once. ``folder`` is where the tokenizers' files are on
    every executor.
    """
    path = os.path.join(folder, f"{name}.tiktoken")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start in range(0, batch.num_rows, 512):
                lists = [encoder.encode(t) if t else [] for t in texts.slice(start, 512).to_pylist()]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([ids.slice(start, 512), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return documents.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(encode, "doc_id bigint, ids array<int>")
