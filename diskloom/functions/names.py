"""Column functions over names and titles: comparison forms, sort forms, search forms, keys and ranks.

All take and return Spark columns and stay in the JVM, except that text outside ASCII goes through one Arrow UDF for
its Unicode decomposition. Text columns use '' for absent; a NULL input gives NULL unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diskloom.functions.text import plain

# Sequel numbers in Roman numerals that searches take for figures, and the reverse. Single letters are not numbers.
ROMAN = {"ii": "2", "iii": "3", "iv": "4", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "xi": "11", "xii": "12", "xiii": "13", "xiv": "14", "xv": "15", "xvi": "16"}
# The narrower set, and the words left out, when titles are compared word by word.
TITLE_ROMAN = {"ii": "2", "iii": "3", "iv": "4", "vi": "6", "vii": "7", "viii": "8", "ix": "9"}
MINOR_WORDS = ("the", "a", "an", "and", "of")
# Articles that follow a comma at the end of a filed title.
ARTICLES = "The|A|An|Le|La|Les|Der|Die|Das|Il|El"
# Ordinals of editions in Latin.
LATIN_EDITIONS = {"bis": "2", "ter": "3", "quater": "4"}


@F.pandas_udf(T.StringType())
def _fold(texts: pd.Series) -> pd.Series:
    """Case-folded text without marks; NULL stays NULL."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _to_ascii(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _plain(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else plain(t), na_action="ignore")


def _only_other(c: Column) -> Column:
    """The text where it is not plain ASCII, else NULL, so that the UDF gets nothing to do for plain rows."""
    return F.when(~c.rlike(r"^\p{ASCII}*$"), c)


def repaired(c: Column) -> Column:
    """Text with damaged encodings, look-alike letters, marks and control characters resolved; printable ASCII stays as it is."""
    return F.coalesce(_plain(F.when(~c.rlike("^[ -~]*$"), c)), c)


def normalise(c: Column) -> Column:
    """Words for comparison: folded case, no marks, apostrophes dropped, "&" as "and", other signs and blanks as one space."""
    folded = F.coalesce(_fold(_only_other(c)), F.lower(c))
    bare = F.regexp_replace(F.replace(folded, F.lit("&"), F.lit(" and ")), "['`‘’´]", "")
    return F.trim(F.regexp_replace(bare, r"(?U)[\W_]+", " "))


def ascii_words(c: Column) -> Column:
    """Words of letters a-z and digits only, others dropped; an apostrophe parts words."""
    folded = F.coalesce(_to_ascii(_only_other(c)), F.lower(c))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    """A stable identifier from a name: "Q-Zap Menu" gives "q-zap-menu"."""
    return F.replace(ascii_words(c), F.lit(" "), F.lit("-"))


def crew_key(c: Column) -> Column:
    """A crew's name for comparison: without apostrophes and a leading "the", "&" as "and"."""
    return F.regexp_replace(ascii_words(F.replace(F.regexp_replace(c, "['’]", ""), F.lit("&"), F.lit(" and "))), "^the ", "")


def words_of(c: Column) -> Column:
    """The words of normalised text as an array, empty for ''."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Normalised words, with numbers set apart from letters: "a250b" gives a, 250, b."""

    def parted(w: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(w, r"^(\p{L}+)(\p{Nd}+)(\p{L}?)$", "$1 $2 $3"), r"^(\p{Nd}+)(\p{L})$", "$1 $2")

    return words_of(F.array_join(F.transform(words_of(normalise(c)), parted), " "))


def search_text(c: Column) -> Column:
    """Normalised words, and the joined form of words with inner signs: "X-Ray" is found as "x ray" and "xray"."""
    joined = F.transform(F.regexp_extract_all(c, F.lit(r"((?U)\w+(?:[-.'/]\w+)+)"), F.lit(1)), lambda w: F.regexp_replace(w, "[-.'/]", ""))
    return F.trim(F.concat_ws(" ", normalise(c), normalise(F.array_join(joined, " "))))


def _map_of(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def title_search_text(c: Column) -> Column:
    """``search_text`` with sequel numbers in the other numerals, and each two neighbouring words joined, where new."""
    base = search_text(c)
    words = words_of(normalise(c))
    numerals = _map_of(ROMAN | {v: k for k, v in ROMAN.items()})
    other = F.filter(F.transform(words, lambda w: F.element_at(numerals, w)), lambda w: w.isNotNull())
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    pairs = F.filter(pairs, lambda w: ~w.rlike(r"^\p{Nd}+$"))
    extra = F.array_except(F.concat(other, pairs), words_of(base))
    return F.when(c.isNotNull(), F.concat_ws(" ", base, F.nullif(F.array_join(extra, " "), F.lit(""))))


def display_title(c: Column) -> Column:
    """A trailing article moved to the front: "Engine, The - Demo" gives "The Engine - Demo"."""
    pattern = rf"^(.+?), ({ARTICLES})\b(.*)$"
    head, article, tail = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    fits = (tail == "") | tail.rlike(r"^( - |:| \()") | (~article.isin("A", "An") & tail.startswith(" "))
    return F.when((article != "") & fits, F.concat(article, F.lit(" "), head, tail)).otherwise(c)


def title_key(c: Column) -> Column:
    """What titles are joined by across sources: without brackets and version, article in front, normalised."""
    base = F.trim(F.regexp_replace(F.replace(c, F.lit(" _ "), F.lit(" & ")), r"(?s)\s*[(\[].*$", ""))
    return normalise(display_title(F.trim(F.regexp_replace(base, r"(?i)\s+v\d[\d.]*[a-z]?$", ""))))


def sort_key(c: Column) -> Column:
    """Normalised text in which numbers sort by value: every number is filled with zeros to eight figures."""
    runs = F.regexp_extract_all(normalise(c), F.lit(r"(\p{Nd}+|\P{Nd}+)"), F.lit(1))
    filled = F.transform(runs, lambda r: F.when(r.rlike(r"^\p{Nd}"), F.lpad(r, F.greatest(F.lit(8), F.length(r)), "0")).otherwise(r))
    return F.array_join(filled, "")


def sort_title(c: Column) -> Column:
    """The sort form of a title: without a leading English article, also one filed at the end."""
    shown = display_title(F.trim(c))
    bare = F.regexp_replace(shown, r"(?i)^(?:the|a|an)\s+(?=\S)", "")
    return F.coalesce(F.nullif(sort_key(bare), F.lit("")), sort_key(shown))


def title_words(c: Column) -> Column:
    """The telling words of a title as a set, numbers as figures; all words if only minor ones are left."""
    numerals = _map_of(TITLE_ROMAN)
    figures = F.array_distinct(F.transform(words_of(normalise(display_title(c))), lambda w: F.coalesce(F.element_at(numerals, w), w)))
    telling = F.filter(figures, lambda w: ~w.isin(*MINOR_WORDS))
    return F.when(F.size(telling) > 0, telling).otherwise(figures)


def title_keys(c: Column) -> Column:
    """The spellings by which a title is looked up: its key, and the whole title with its article in front and as it is."""
    return F.filter(F.array_distinct(F.array(title_key(c), normalise(display_title(c)), normalise(c))), lambda k: k != "")


def base_name(c: Column) -> Column:
    """A file name without its folders, either slash."""
    return F.regexp_extract(F.regexp_replace(c, r"\\", "/"), r"([^/]*)/*$", 1)


def image_name_keys(c: Column) -> Column:
    """What image files are joined by: lower-case name without folders, with and without its extension."""
    base = F.lower(base_name(c))
    stem = F.when(base.contains("."), F.regexp_extract(base, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(base)
    return F.array_distinct(F.array(base, stem))


def suffix_of(c: Column) -> Column:
    """The extension of a file name in lower case without the dot, '' if it has none."""
    return F.lower(F.regexp_extract(base_name(c), r"\.([^.]+)$", 1))


def sanitise_name(c: Column, fallback: str = "download") -> Column:
    """A file name that any file system takes: no folders, control or reserved signs, dots or blanks at the ends."""
    name = F.regexp_replace(base_name(c), r'[\x00-\x1f<>:"|?*]', "_")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(name, r"^[\s.]+|[\s.]+$", ""), r"\s+", " "), F.lit("")), F.lit(fallback))


def normalise_part(c: Column) -> Column:
    """One spelling of a disk's part: "Disk 1 of 2", "1" and "a" are "A"; longer texts in capitals."""
    text = F.trim(c)
    number = F.regexp_extract(text, r"(?i)^(?:disk|side|part)?\s*(\d+)\s*(?:of\s*\d+)?$", 1)
    n = number.try_cast("int")
    letter = F.when((n >= 1) & (n <= 26), F.char(n + 64)).otherwise(n.cast("string"))
    return F.when(number != "", letter).otherwise(F.upper(text))


def _edition(major: Column, minor: Column) -> Column:
    whole = F.coalesce(F.nullif(F.ltrim(major, F.lit("0")), F.lit("")), F.lit("0"))
    rest = F.rtrim(minor, F.lit("0"))
    number = F.when(rest != "", F.concat(whole, F.lit("."), rest)).otherwise(whole)
    return F.when(number == "1", "").otherwise(F.concat(F.lit("v"), number))


def normalise_version(c: Column) -> Column:
    """One spelling of a version: "Version 2", "V2.0" and "bis" are "v2", the first is ''; text without figures is kept."""
    text = F.lower(F.trim(c))
    text = F.coalesce(F.element_at(_map_of(LATIN_EDITIONS), text), text)
    major, minor = F.regexp_extract(text, r"(\d+)(?:\.(\d+))?", 1), F.regexp_extract(text, r"(\d+)(?:\.(\d+))?", 2)
    return F.when(major == "", text).otherwise(_edition(major, minor))


def format_label(template: Column, name: Column, number: Column, part: Column, version: Column) -> Column:
    """A series label from its template; the bare name where there is no number."""
    filled = template
    spaced = lambda x: F.when(x != "", F.concat(F.lit(" "), x)).otherwise("")
    values = {
        "{name}": name, "{number}": number.cast("string"), "{number3}": F.lpad(number.cast("string"), F.greatest(F.lit(3), F.length(number.cast("string"))), "0"),
        "{part}": part, "{part_suffix}": spaced(part), "{version}": version, "{version_suffix}": spaced(version),
    }
    for slot, value in values.items():
        filled = F.replace(filled, F.lit(slot), F.coalesce(value, F.lit("")))
    return F.when(number.isNull(), name).otherwise(F.trim(filled))


def akas(c: Column) -> Column:
    """Other titles from a remark such as "aka First; Second"."""
    listed = F.regexp_extract(c, r"(?i)(?:^|\s)aka\s+(.+)$", 1)
    return F.filter(F.transform(F.split(listed, r"\s*;\s*"), lambda t: F.trim(t)), lambda t: t != "")


def distinct_words(c: Column) -> Column:
    """Each word of a text once, in order of first appearance."""
    return F.array_join(F.array_distinct(words_of(F.regexp_replace(F.trim(c), r"\s+", " "))), " ")


def file_name_words(names: Column) -> Column:
    """Search words of file names, with their extensions."""
    return F.array_join(F.array_distinct(F.flatten(F.transform(names, lambda n: words_of(F.lower(F.regexp_replace(n, r"[\W_]+", " ")))))), " ")


# Where a combined entry falls into titles (an "&" behind brackets, before a title with its date), and partial dates.
COMBINED = r"(?<=[)\]])\s+&\s+(?=[^()\[\]]+?\s\([12][0-9x]{3}[-0-9x]*\))"
PARTIAL_DATE = r"^\s*(\d{4})(?:-(\d{1,2}|[xX?]{2})(?:-(\d{1,2}|[xX?]{2}))?)?(?!\d)"


def split_combined(c: Column) -> Column:
    """The titles of a combined entry "A (1990)(X) & B (1991)(Z)"; a plain name as a single one."""
    parts = F.split(F.trim(c), COMBINED)
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda p: p != "")


def dump_flags(c: Column) -> Column:
    """The texts in square brackets."""
    return F.regexp_extract_all(c, F.lit(r"\[([^\]]*)\]"), F.lit(1))


def image_rank_key(flags: Column) -> Column:
    """Rank of a dump among those of one disc by its flags (array), best first: ``struct(worse, alternate, unverified)``."""
    has = lambda pattern: F.exists(flags, lambda f: f.rlike(pattern))
    worse = F.when(has(r"^b\d*(\s|$)"), 2).when(has(r"^[hmfouvp]\d*(\s|$)") | has(r"^t( |$)"), 1).otherwise(0)
    first = F.try_element_at(F.filter(flags, lambda f: f.rlike(r"^a\d*(\s|$)")), F.lit(1))
    number = F.regexp_extract(first, r"^a(\d*)", 1)
    alternate = F.when(first.isNull(), 0).otherwise(F.coalesce(F.nullif(number, F.lit("")), F.lit("1")).cast("int"))
    return F.struct(worse.alias("worse"), alternate.alias("alternate"), F.when(F.array_contains(flags, "!"), 0).otherwise(1).alias("unverified"))


def parse_date(c: Column) -> Column:
    """``struct(year, month, day)`` of a partial date "1990", "1990-06" or "1990-06-xx"; parts out of range are NULL, a day needs its month."""
    part = lambda i: F.regexp_extract(c, PARTIAL_DATE, i).try_cast("int")
    ranged = lambda n, low, high: F.when((n >= low) & (n <= high), n)
    year, month, day = ranged(part(1), 1950, 2100), ranged(part(2), 1, 12), ranged(part(3), 1, 31)
    month = F.when(year.isNotNull(), month)
    return F.struct(year.alias("year"), month.alias("month"), F.when(month.isNotNull(), day).alias("day"))


def strict_date(c: Column) -> Column:
    """The same of a typed correction, but NULL as a whole unless every given part exists in the calendar."""
    text = F.trim(c)
    full, month, year = (F.try_to_date(F.concat(text, F.lit(tail))) for tail in ("", "-01", "-01-01"))
    is_full, is_month, is_year = (text.rlike(p) for p in (r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}$", r"^\d{4}$"))
    day = F.when(is_full, full).when(is_month, month).when(is_year, year)
    parts = F.struct(F.year(day).alias("year"), F.when(~is_year, F.month(day)).alias("month"), F.when(is_full, F.dayofmonth(day)).alias("day"))
    return F.when(day.isNotNull(), parts)


def date_text(date: Column) -> Column:
    """A partial date written out: "1990", "1990-06" or "1990-06-30", '' without a year."""
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    text = F.concat_ws("-", date["year"].cast("string"), two(date["month"]), F.when(date["month"].isNotNull(), two(date["day"])))
    return F.when(date["year"].isNull(), "").otherwise(text)


def date_words(date: Column) -> Column:
    """A date as search words: the year, or "1990 06"."""
    return F.concat_ws(" ", date["year"].cast("string"), F.lpad(date["month"].cast("string"), 2, "0"))


def precision(date: Column) -> Column:
    """How exact a partial date is: 0 to 3."""
    return F.when(date["year"].isNull(), 0).when(date["month"].isNull(), 1).when(date["day"].isNull(), 2).otherwise(3)


def url_key(c: Column) -> Column:
    """What addresses are compared by: decoded, trimmed, in lower case; a plus stays a plus."""
    return F.lower(F.trim(F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)))


def host_of(c: Column) -> Column:
    """The host of an address in lower case, '' if it has none."""
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def register(spark) -> None:
    """Make the forms that SQL users need available to ``spark.sql``: ``fold_text``, ``fold_ascii``, ``dump_name`` and, as SQL functions, ``normalise_text`` and ``sort_form``."""
    from diskloom.functions.dumpnames import _parsed

    spark.udf.register("fold_text", _fold)
    spark.udf.register("fold_ascii", _to_ascii)
    spark.udf.register("dump_name", _parsed)
    words = r"""trim(regexp_replace(regexp_replace(replace(if(c rlike r'^\p{ASCII}*$', lower(c), fold_text(c)), '&', ' and '), r"['`‘’´]", ''), r'(?U)[\W_]+', ' '))"""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalise_text(c STRING) RETURNS STRING RETURN {words}")
    fill = r"array_join(transform(regexp_extract_all(normalise_text(c), r'(\p{Nd}+|\P{Nd}+)', 1), x -> if(x rlike r'^\p{Nd}', lpad(x, greatest(8, length(x)), '0'), x)), '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION sort_form(c STRING) RETURNS STRING RETURN {fill}")
