"""Folding of typed text: damaged encodings, entities, look-alike letters, diacritics, digits for letters."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones, and Latin letters that do not decompose.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ɡ": "g", "г": "r", "п": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X",
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŋ": "n",
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th",
    "’": "'", "‘": "'", "ʼ": "'", "`": "'", "´": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", "‐": "-", "‑": "-",
}
_TABLE = str.maketrans(LOOK_ALIKES)
_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_TWICE = re.compile("[Â-ôŒŠŽ][\u0080-¿ŒœŠšŸŽžƒˆ˜–-…‰‹›€™]")


def _to_bytes(text: str) -> bytes | None:
    """The bytes that ``text`` was read from as Windows-1252 or Latin-1, or None."""
    out = bytearray()
    for ch in text:
        if ord(ch) < 256:
            out.append(ord(ch))
        else:
            try:
                out += ch.encode("cp1252")
            except UnicodeEncodeError:
                return None
    return bytes(out)


def repair_encoding(text: str) -> str:
    """UTF-8 that was read as an 8-bit code page, read properly; other text unchanged. Twice-damaged text is repaired twice."""
    for _ in range(2):
        if not _TWICE.search(text):
            break
        parts = re.split(r"([\u0080-\U0010ffff]+)", text)  # only runs of other than ASCII can be damaged
        for i in range(1, len(parts), 2):
            raw = _to_bytes(parts[i])
            if raw is not None:
                try:
                    parts[i] = raw.decode("utf-8")
                except UnicodeDecodeError:
                    pass
        fixed = "".join(parts)
        if fixed == text:
            break
        text = fixed
    return text


def plain(text: str) -> str:
    """Text with entities, damaged encodings, compatibility forms, diacritics, look-alikes and invisible characters resolved; case is kept."""
    if text.isascii():
        if "&" in text:
            text = html.unescape(text)
        if text.isascii():
            return _CONTROL.sub("", text)
    text = html.unescape(repair_encoding(text))
    text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))
    text = "".join(ch for ch in text if not unicodedata.combining(ch))
    return _CONTROL.sub("", text.translate(_TABLE))


# Digits and signs written for letters.
_LEET = str.maketrans("013457@$!|", "oieastasii")
_MIXED = re.compile(r"[0-9@$!|]*[A-Za-z][A-Za-z0-9@$!|]*[A-Za-z0-9@$|]")


def unleet(word: str) -> str:
    """Digits standing for letters inside a word of letters turned back ("m3nu" to "menu"); numbers and "56a" stay."""
    if word.isalpha() or not any(c.isdigit() or c in "@$" for c in word):
        return word
    letters = sum(c.isalpha() for c in word)
    digits = sum(c.isdigit() or c in "@$" for c in word)
    read = word.translate(_LEET)
    if read.lower() != "the" and (letters < 2 or any(c in "2689" for c in word) or digits > letters + 2):
        return word
    return read


_CAMEL = re.compile(r"(?<=[a-z]{2})(?=[A-Z][a-z]{2})")


def split_camel(text: str) -> str:
    """Words run together with capitals ("StaxunegDungeon") set apart; text in alternating or swapped case stays."""
    if re.search(r"\b[a-z]+[A-Z]{2}|\b[a-z][A-Z]", text):
        return text
    return _CAMEL.sub(" ", text)


# What is written where a value is not known.
STAND_INS = frozenset(
    "unknown|(unknown)|<unknown>|[unknown]|unknown artist|unk|unknwon|not known|not available|not applicable|n/a|na|n.a.|n.a|none|(none)|<none>|null|(null)|nil|nan|tba|tbc|tbd|"
    "to be announced|anonymous|inconnu|inconnue|unbekannt|onbekend|desconocido|sconosciuto|okänd|various|misc|empty|blank|undefined|no name|noname|missing|nobody|no one|?".split("|")
)


def says_nothing(value: str | None) -> bool:
    """Whether a value is absent or a stand-in for an absent one: NULL, blank, signs only, or one of the fixed words."""
    if value is None:
        return True
    text = plain(value).strip().lower()
    return not any(c.isalnum() for c in text) or text in STAND_INS or text.strip("()<>[]{}\"'.*- ") in STAND_INS
