"""Edit distances and letter skeletons of short strings."""

from __future__ import annotations

import re


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from ``a`` to ``b``, or ``most`` + 1 if there are more.

    Only the band of ``most`` cells on either side of the diagonal is computed.
    """
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    far = most + 1
    before: list[int] = []
    last = list(range(m + 1))
    for i in range(1, n + 1):
        lo, hi = max(1, i - most), min(m, i + most)
        row = [far] * (m + 1)
        if lo == 1:
            row[0] = i
        best = far
        x = a[i - 1]
        for j in range(lo, hi + 1):
            y = b[j - 1]
            v = last[j - 1] + (x != y)
            if row[j - 1] < v:
                v = row[j - 1] + 1
            if last[j] < v:
                v = last[j] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < v:
                v = before[j - 2] + 1
            row[j] = v
            if v < best:
                best = v
        if best > most:
            return far
        before, last = last, row
    return min(last[m], far)


_DOUBLE = re.compile(r"(.)\1+")
_VOWELS = re.compile(r"[aeiou]")


def single(word: str) -> str:
    """Repeated letters written once."""
    return _DOUBLE.sub(r"\1", word)


def consonants(word: str) -> str:
    """A word as it is typed without its vowels."""
    return _VOWELS.sub("", word)


def skeleton(word: str) -> str:
    """The consonants of a word, repeated ones once."""
    return single(_VOWELS.sub("", word))


def sound(word: str) -> str:
    """A lower-case word with letters and groups that are typed for one another made equal."""
    for a, b in (("ph", "f"), ("ck", "k"), ("cks", "x"), ("cs", "x"), ("ks", "x"), ("qu", "k"), ("c", "k"), ("q", "k"), ("z", "s"), ("y", "i"), ("w", "v")):
        word = word.replace(a, b)
    return word
