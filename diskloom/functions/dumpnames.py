"""Names of disc dumps that follow the preservation naming rules, taken apart.

"Title, The v1.2 (1990-06)(Publisher)(Disk 1 of 2)[cr Crew][a2].st": a title, round brackets for date, publisher and
further facts, square brackets for what was done to the dump.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diskloom.functions.names import COMBINED

# File types of dumps, and words for a protector against viruses.
EXTENSIONS = frozenset("7z adf adz dim dms gz hfe img ipf lha lzx msa raw scp st stx zip".split())
_GUARDS = ("antivirus", "anti-virus", "protector", "virus free")
_PAIRS = {")": "(", "]": "["}
_DATE = re.compile(r"[12][0-9x]{3}(?:-[0-9x]{2}){0,2}$", re.I)
_COMBINED = re.compile(COMBINED)
_TEXT, _LIST = T.StringType(), T.ArrayType(T.StringType())
SCHEMA = T.StructType(
    [T.StructField(n, _TEXT) for n in ("title", "version", "date", "publisher", "cracker", "trainer", "trainer_group", "trainer_count", "modified_by", "extension", "virus", "antivirus", "media", "part")]
    + [T.StructField(n, _LIST) for n in ("extra", "flags")]
    + [T.StructField(n, T.BooleanType()) for n in ("bad", "verified", "virus_damage", "combined")]
    + [T.StructField(n, T.IntegerType()) for n in ("alternate", "disk", "disks")]
)


def trailing_brackets(text: str) -> tuple[str, list[tuple[str, str]]]:
    """A name parted into what stands before its last brackets, and those as (opening sign, content).

    Opening signs are matched with their closing ones in one pass; then brackets that touch the end, with nothing but
    blanks (and a dash between a round and a square one) between them, are taken off. Something must be left before
    them.
    """
    closes: dict[int, int] = {}
    stacks: dict[str, list[int]] = {"(": [], "[": []}
    for i, c in enumerate(text):
        if c in stacks:
            stacks[c].append(i)
        elif c in _PAIRS and stacks[_PAIRS[c]]:
            closes[i] = stacks[_PAIRS[c]].pop()
    end, found = len(text.rstrip()), []
    square = True  # square brackets come last
    while end and (start := closes.get(end - 1)) is not None and text[:start].strip():
        kind = text[start]
        if kind == "[" and not square:
            break
        square = kind == "["
        found.append((kind, text[start + 1 : end - 1].strip()))
        end = len(text[:start].rstrip())
        if kind == "[" and text[:end].endswith(")-"):
            end -= 1
    return text[:end].strip(), found[::-1]


def _once(values: Iterator[str]) -> str:
    return " - ".join(dict.fromkeys(v for v in values if v))


def _one(name: str) -> dict:
    title, brackets = trailing_brackets(name)
    fields = [x for k, x in brackets if k == "("]
    flags = [x for k, x in brackets if k == "["]
    dated = next((i for i, f in enumerate(fields) if _DATE.match(f)), None)
    date = publisher = ""
    extra = fields
    if dated is not None:
        date = fields[dated]
        after = fields[dated + 1 :]
        publisher = "" if not after or after[0] == "-" else after[0]
        extra = fields[:dated] + after[1:]
    version = ""
    if m := re.match(r"(?i)(?P<t>.*?\S)\s+(?P<v>v\d+(?:[.-]\d+)*[a-z]?|Rev \d+(?:\.\d+)*)$", title):
        title, version = m["t"], m["v"]
    out = dict(title=title, version=version, date=date, publisher=publisher, extra=extra, flags=flags, trainer="", bad=False, alternate=0, verified="!" in flags)
    crackers, changers, viruses, guards = [], [], [], []
    damage = False
    for flag in flags:
        head, _, rest = flag.partition(" ")
        rest, stem = rest.strip(), re.match(r"[a-z]*", head)[0] if re.fullmatch(r"[a-z]+\d*", head) else ""
        damage |= "virus damage" in flag.lower()
        if stem == "v":
            viruses.append(rest or "unknown")
        elif stem in ("m", "a") and rest and any(w in flag.lower() for w in _GUARDS):
            guards.append(rest)
        if head == "cr":
            crackers.append(rest)
        elif head == "t":
            out["trainer"] = flag
        elif head in ("h", "m"):
            changers.append(rest)
        elif stem == "b":
            out["bad"] = True
        elif stem == "a" and not out["alternate"]:
            out["alternate"] = int(head[1:] or 1)
    out |= dict(cracker=_once(iter(crackers)), modified_by=_once(iter(changers)), virus=_once(iter(viruses)), antivirus=_once(iter(guards)), virus_damage=damage)
    return out


def parse_dump_name(name: str | None) -> dict | None:
    """The facts of a dump's name, with or without a file extension; None for None. Every text is '' where it is absent.

    A combined entry "A (1990)(X) & B (1991)(Y)" gives the joined titles, the first date, and the different publishers,
    crackers and so on of its titles.
    """
    if name is None:
        return None
    text, extension = name.strip(), ""
    if (m := re.search(r"\.([A-Za-z0-9]{1,5})$", text)) and (m[1].lower() in EXTENSIONS or text[: m.start()].endswith((")", "]"))):
        text, extension = text[: m.start()], m[1].lower()
    parts = [_one(p) for p in (x.strip() for x in _COMBINED.split(text)) if p] or [_one(text)]
    out = dict(parts[0])
    if len(parts) > 1:
        every = lambda key: [p[key] for p in parts]
        out |= dict(title=" & ".join(every("title")), version="", publisher=_once(iter(every("publisher"))), extra=list(dict.fromkeys(x for e in every("extra") for x in e)), flags=[x for e in every("flags") for x in e])
        out |= dict(cracker=_once(x for c in every("cracker") for x in c.split(" - ")), trainer=next((t for t in every("trainer") if t), ""))
        out |= {key: _once(iter(every(key))) for key in ("modified_by", "virus", "antivirus")}
        out |= dict(bad=any(every("bad")), alternate=max(every("alternate")), verified=all(every("verified")), virus_damage=any(every("virus_damage")))
    words = out["trainer"].split()[1:]
    counted = words[:1] if words and words[0].startswith("+") else []
    disk = next((m for x in out["extra"] if (m := re.match(r"(?i)dis[kc]\s+(\d+)\s+of\s+(\d+)", x))), None)
    part = next((m for x in out["extra"] if (m := re.match(r"(?i)part\s+([a-z0-9]+)\b(?:\s+(?:disk|side)\s+([a-z0-9]+)\b)?", x))), None)
    side = next((m for x in out["extra"] if (m := re.match(r"(?i)side\s+([a-z0-9]+)\b", x))), None)
    out |= dict(
        extension=extension, combined=len(parts) > 1, trainer_count="".join(counted), trainer_group=" ".join(words[len(counted) :]),
        media=next((x for x in out["extra"] if re.match(r"(?i)(?:disk|disc|side|part|tape|file)\s", x)), ""),
        part="".join(g for g in part.groups() if g) if part else side[1] if side else disk[1] if disk else "",
        disk=int(disk[1]) if disk else None, disks=int(disk[2]) if disk else None,
    )
    return out


@F.pandas_udf(SCHEMA)
def _parsed(names: pd.Series) -> pd.DataFrame:
    columns = SCHEMA.fieldNames()
    rows = [parse_dump_name(n) or {} for n in names]
    return pd.DataFrame([[r.get(c) for c in columns] for r in rows], columns=columns)


def dump_name(c: Column) -> Column:
    """``parse_dump_name`` of a column as a struct; brackets nest from the right, which no regular expression can follow."""
    return _parsed(c)


def tidy_label(c: Column) -> Column:
    """A short label from a dump's name: the titles with article in front, its medium and cracker."""
    from diskloom.functions.names import display_title, split_combined

    parts = F.transform(split_combined(F.regexp_replace(c, r"\.[A-Za-z0-9]{1,4}$", "")), lambda p: p)
    one = _parsed(c)
    title = F.concat_ws(" ", display_title(one["title"]), F.nullif(one["version"], F.lit("")))
    single = F.concat(title, F.when(one["media"] != "", F.concat(F.lit(" ("), one["media"], F.lit(")"))).otherwise(""), F.when(one["cracker"] != "", F.concat(F.lit(" [cr "), one["cracker"], F.lit("]"))).otherwise(""))
    return F.coalesce(F.nullif(F.when(F.size(parts) > 1, one["title"]).otherwise(single), F.lit("")), F.trim(c))
