"""Mapping of freely typed series names to a canonical list."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diskloom.functions.strings import consonants, edit_distance, skeleton
from diskloom.functions.text import plain, split_camel, unleet
from diskloom.operators.skew import lookup_join

# What kind of series a name says, and how people write that.
SERIES_KINDS = {
    "compilation": "compilation compilations compils compil comp compo kompilation",
    "intro": "introdisks introdisk introdiscs introdisc intros intro",
    "music": "musicdisks musicdisk musicdiscs musicdisc musikdisks musikdisk musikdiscs musics music",
    "mega": "megadisks megadisk megadiscs megadisc megas mega",
    "utility": "utilitydisks utilitydisk utilitydiscs utilitydisc utilities utility utils util utildisk utildisks utildisc",
    "menu": "menu menus menudisk menudisks menudisc menudiscs menue mnu",
    "pack": "pack packs pak pk pck packdisk packdisks packdisc packdiscs",
    "collection": "collection collections collectn coll kollektion kollection collect",
    "compact": "compactdisks compactdisk compactdiscs compactdisc compacts compact compakt cdscompact compactcds compactcd",
    "demo": "demoseries demoserie demos demo demosseries",
}
_KIND = {w: k for k, words in SERIES_KINDS.items() for w in words.split()}
_KIND_SKELETON = {skeleton(w): k for w, k in sorted(_KIND.items(), key=lambda x: len(x[0])) if len(skeleton(w)) >= 2}
_PLATFORM_HINT = {"st": "atari-st", "atari": "atari-st", "atarist": "atari-st", "amiga": "amiga", "ami": "amiga"}
#: Share of the weighted trigrams of a typed name that a candidate's form must hold.
LEAST_COMMON = 0.1
_TAIL = re.compile(r"\s+(?:-\s*)?(?:all\s+(?:discs?|disks?)|incomplete|complete|cd|dvd|by\s+\S.*|(?:vol(?:ume)?|nr|no|number|issue|part|disks?|discs?)\b\.?\s*#?\d+\s*[a-z]?|#\s*\d+\s*[a-z]?|\d+\s*[a-z]?)\s*$")
_NUMBER = re.compile(r"^(?:#|no\.?|nr\.?|vol\.?)?\d+[a-z]?$")


def series_kind(word: str) -> str:
    """The kind that a run-together word says, allowing for typing errors; '' if none."""
    if word in _KIND:
        return _KIND[word]
    if len(word) >= 3:
        if not re.search("[aeiou]", word) and skeleton(word) in _KIND_SKELETON:
            return _KIND_SKELETON[skeleton(word)]
    if len(word) >= 4:
        most = 1 if len(word) < 8 else 2
        near = [(edit_distance(word, w, most), -len(w), k) for w, k in _KIND.items() if len(w) >= 4]
        best = min(near)
        if best[0] <= most:
            return best[2]
    if len(word) >= 6 and skeleton(word) in _KIND_SKELETON:
        return _KIND_SKELETON[skeleton(word)]
    return ""


def parse_series_name(value: str) -> tuple[str, str, str, str]:
    """A typed series name taken apart: (name words without the kind, kind, platform hint, letters if it may be an acronym).

    Brackets, quotes, volume numbers, remarks, a leading "the" and the order of kind and name make no difference.
    """
    text = plain(value or "")
    hint = ""
    for m in re.finditer(r"\(\s*([A-Za-z ]+)\s*\)", text):
        hint = _PLATFORM_HINT.get(m[1].replace(" ", "").lower(), hint)
    text = re.sub(r"\([^)]*\)", " ", text)
    text = re.sub(r"[\[\]\"*{}<>|~^]", " ", text).strip(" '-.,;:!?")
    bare = re.sub(r"[^A-Za-z]", "", text)
    letters = bare.lower() if text == bare and bare.isupper() and 3 <= len(bare) <= 6 else ""
    text = split_camel(text).lower()
    while (cut := _TAIL.sub("", " " + text).strip()) != text:
        text = cut
    words = [unleet(w) for w in re.split(r"[^a-z0-9@$]+", text) if w and not _NUMBER.match(w)]
    words = [re.sub("[^a-z]", "", w) for w in words]
    if words and all(len(w) == 1 for w in words) and len(words) > 3:
        words = ["".join(words)]
    words = [w for i, w in enumerate(words) if w and not (i == 0 and w in ("the", "teh", "hte")) and w != "the"]
    kind = ""
    for at in (lambda n: slice(len(words) - n, len(words)), lambda n: slice(0, n)):
        for n in (2, 1):
            if len(words) >= n and not kind and (found := series_kind("".join(words[at(n)]))):
                kind = found
                words[at(n)] = []
        if kind:
            break
    if not kind and len(words) == 1:
        for w in sorted((w for w in _KIND if len(w) >= 4), key=len, reverse=True):
            if words[0].endswith(w) and len(words[0]) > len(w) + 3:
                kind, words = _KIND[w], [words[0][: -len(w)]]
                break
            if words[0].startswith(w) and len(words[0]) > len(w) + 3:
                kind, words = _KIND[w], [words[0][len(w) :]]
                break
    return " ".join(words), kind, hint, letters


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [parse_series_name(v) for v in b["value"]]
        yield b.assign(name=[r[0] for r in rows], kind=[r[1] for r in rows], hint=[r[2] for r in rows], letters=[r[3] for r in rows])


def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forms under which a canonical name is indexed: in full, without vowels, with initials for leading words."""
    for b in batches:
        out = []
        for name in b["name"]:
            words = name.split()
            forms = {"".join(words), "".join(consonants(w) for w in words)}
            if len(words) > 1:
                forms.add("".join(words[:-1]) + consonants(words[-1]))
                forms.add("".join(w[0] for w in words[:-1]) + words[-1])
                forms.add("".join(w[0] for w in words[:-1]) + consonants(words[-1]))
                forms.add(words[-1])
            out += [(name, f) for f in forms if f]
        yield pd.DataFrame(out, columns=["name", "form"])


def _glue(c: str):
    return F.regexp_replace(c, " ", "")


def _grams(c: str):
    """Distinct character trigrams of a padded string."""
    padded = F.concat(F.lit("^^"), F.col(c), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3)))


def pairs_of(text: str) -> set[str]:
    """Character n-grams with gaps: the ordered pairs of letters at most three places apart, ends included. A slip spoils few of them."""
    s = f"^{text}$"
    return {s[i] + s[j] for i in range(len(s)) for j in range(i + 1, min(len(s), i + 4))}


def _cosines(weights: dict[str, float], unknown: float):
    """Cosine of each typed name and form by rarity-weighted gapped n-grams."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[set[str], float]] = {}

        def sized(text: str) -> tuple[set[str], float]:
            if text not in known:
                grams = pairs_of(text)
                known[text] = grams, math.sqrt(sum(weights.get(g, unknown) ** 2 for g in grams))
            return known[text]

        for b in batches:
            if len(known) > 200_000:
                known.clear()
            out = []
            for typed, form in zip(b["glued"], b["form"]):
                (x, m), (y, n) = sized(typed), sized(form)
                out.append(sum(weights.get(g, unknown) ** 2 for g in x & y) / (m * n))
            yield b.assign(score=out)

    return score


def within_edits(typed: str, form: str) -> bool:
    """Whether a typed name lies within the slips that a form's length allows; a form without vowels stands for a name typed without any."""
    most = 3 if len(form) >= 14 else 2 if len(form) >= 7 else 1 if len(form) >= 5 else 0
    if not re.search("[aeiou]", form) and re.search("[aeiou]", typed):
        most = 0
    return edit_distance(typed, form, most) <= most


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.loc[[any(within_edits(t, f) for f in fs) for t, fs in zip(b["glued"], b["forms"])], ["name", "listed", "score"]]


def match_names(typed: DataFrame, listed: DataFrame, *, least_score: float = 0.35, least_margin: float = 0.05) -> DataFrame:
    """The listed name that each typed name (both in a column ``name``) means: ``name, listed, score``.

    An inverted index of character trigrams over the forms of the listed names gives the candidates: all that share
    LEAST_COMMON of the rarity-weighted trigrams. Their score is the cosine of gapped character n-grams weighted by
    rarity among the listed names (one unknown there weighs most). The best listed name is accepted if it scores
    ``least_score`` and leads the next one by ``least_margin``. An exact check follows: the typed name must lie within
    one to three edits, by length, of a form of it. Names that share no trigram with the list, and empty ones, give no
    row.
    """
    forms = listed.where("name <> ''").select("name").distinct().mapInPandas(_variants, "name string, form string").distinct()
    index = forms.select(F.col("name").alias("listed"), "form", F.explode(_grams("form")).alias("gram"))
    names = max(forms.select("name").distinct().count(), 1)
    n = F.lit(float(names))
    weights = index.groupBy("gram").agg(F.log(1 + n / F.countDistinct("listed")).alias("w"))
    index = index.join(weights, "gram")
    norms = index.groupBy("listed", "form").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    index = index.join(norms, ["listed", "form"])
    words = typed.where("name <> ''").select("name").distinct().select("name", F.regexp_replace("name", " ", "").alias("glued"))
    grams = words.select("name", "glued", F.explode(_grams("glued")).alias("gram"))
    own = grams.join(weights, "gram", "left").groupBy("name").agg(F.sqrt(F.sum(F.pow(F.coalesce("w", F.log(1 + n)), 2))).alias("own"))
    met = grams.join(index, "gram").groupBy("name", "glued", "listed", "form").agg((F.sum(F.col("w") * F.col("w")) / F.first("size")).alias("dot"))
    met = met.join(own, "name").where(F.col("dot") >= LEAST_COMMON * F.col("own")).select("name", "glued", "listed", "form")
    rare = forms.mapInPandas(_form_pairs, "name string, gram string")
    by_pair = {r["gram"]: math.log(1 + names / r["n"]) for r in rare.distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}  # pairs of letters of the alphabet: under a thousand
    scores = met.mapInPandas(_cosines(by_pair, math.log(1 + names)), "name string, glued string, listed string, form string, score double")
    best = scores.groupBy("name", "glued", "listed").agg(F.max("score").alias("score"), F.collect_set("form").alias("forms"))  # six forms at most
    order = Window.partitionBy("name").orderBy(F.col("score").desc(), "listed")
    ranked = best.withColumn("k", F.row_number().over(order)).where("k <= 2").withColumn("rival", F.lead("score").over(order)).where("k = 1")
    clear = (F.col("score") >= least_score) & (F.col("score") - F.coalesce("rival", F.lit(0.0)) >= least_margin)
    return ranked.where(clear).select("name", "glued", "listed", "forms", "score").mapInPandas(_verify, "name string, listed string, score double")


def _form_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([(n, g) for n, f in zip(b["name"], b["form"]) for g in pairs_of(f)], columns=["name", "gram"])


def _initials(name: str) -> list[str]:
    words = re.findall(r"[a-z]+", plain(name or "").lower())
    return sorted({"".join(w[0] for w in ws) for ws in (words, words[1:] if words[:1] == ["the"] else words) if ws})


def _parse_listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [parse_series_name(v) for v in b["full"]]
        yield pd.DataFrame({"id": b["id"], "platform": b["platform"], "name": [r[0] for r in rows], "kind": [r[1] for r in rows], "initials": [_initials(v) for v in b["full"]]})


def map_to_series(typed: DataFrame, series: DataFrame, **parameters) -> DataFrame:
    """Each distinct typed (``value``, ``platform``) with the series it means: ``value, platform, series_id``.

    The typed values are deduplicated, taken apart (``parse_series_name``) and matched by ``match_names``. Of the
    series of the matched name those of the given platform (or of the one written in brackets) and of the typed kind
    are kept; exactly one must be left. Letters such as "TXID" mean the only series with these initials on the
    platform. ``series_id`` is '' for a value that means no listed series or more than one, also for a NULL or empty
    one. No typed values, or an empty list of series, are handled alike.
    """
    values = typed.select("value", "platform").distinct().mapInPandas(_parse, "value string, platform string, name string, kind string, hint string, letters string")
    values = values.withColumn("on", F.coalesce("platform", F.nullif("hint", F.lit("")))).withColumn("letters", F.nullif("letters", F.lit("")))
    listed = series.select("id", F.col("name").alias("full"), "platform").where("id IS NOT NULL").mapInPandas(_parse_listed, "id string, platform string, name string, kind string, initials array<string>")
    best = match_names(values, listed, **parameters).select("name", "listed")
    fits = lambda a, b: F.col(a).isNull() | F.col(a).eqNullSafe(F.col(b))
    l = listed.select(F.col("name").alias("listed"), "id", F.col("platform").alias("l_platform"), F.col("kind").alias("l_kind"), "initials")  # noqa: E741
    named = values.join(best, "name").join(l.drop("initials"), "listed").where(fits("on", "l_platform") & ((F.col("kind") == "") | (F.col("kind") == F.col("l_kind"))))
    spelt = values.where("letters IS NOT NULL").join(l.select("id", "l_platform", F.explode("initials").alias("letters")), "letters").where(fits("on", "l_platform"))
    found = named.select("value", "platform", "id", F.lit(0).alias("way")).unionByName(spelt.select("value", "platform", "id", F.lit(1).alias("way")))
    found = found.groupBy("value", "platform", "way").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    found = found.groupBy("value", "platform").agg(F.min(F.struct("way", "low", "high")).alias("f")).where("f.low = f.high").select("value", "platform", F.col("f.low").alias("series_id"))
    same = F.expr("v.value <=> f.value AND v.platform <=> f.platform")
    return values.select("value", "platform").alias("v").join(found.alias("f"), same, "left").select("v.value", "v.platform", F.coalesce("f.series_id", F.lit("")).alias("series_id"))


def map_aliases(aliases: DataFrame, series: DataFrame, **parameters) -> DataFrame:
    """``alias_id, series_id`` for every row id of a table of typed aliases; repeated rows give one row.

    An id whose rows differ takes the smallest series that one of them means. NULL ids are left out.
    """
    rows = aliases.where("alias_id IS NOT NULL").select("alias_id", F.col("alias").alias("value"), "platform")
    mapped = map_to_series(rows, series, **parameters)
    coded = F.to_json(F.array("value", "platform"))  # NULL is a value here
    joined = lookup_join(rows.select("alias_id", coded.alias("key")), mapped.select(coded.alias("key"), "series_id"), "key", "inner")
    return joined.groupBy("alias_id").agg(F.coalesce(F.min(F.nullif("series_id", F.lit(""))), F.lit("")).alias("series_id"))
