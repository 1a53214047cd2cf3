"""SQL of text forms, as DuckDB runs it, for checking the column functions of ``functions.names`` on whole tables.

Each function takes an SQL expression and returns one. DuckDB strips accents but knows no compatibility forms, so those
are listed here.
"""

from __future__ import annotations

# Compatibility forms of Unicode that names hold, and what they stand for: signs one to one, then the others.
_WIDE = "".join(chr(0xFEE0 + i) for i in range(0x21, 0x7F))
_PLAIN = "".join(chr(i) for i in range(0x21, 0x7F))
_SIGNS, _FOR = " ¯¨´¸¹²³ºª", "     123oa"
_LONGER = {"…": "...", "¼": "1⁄4", "½": "1⁄2", "¾": "3⁄4", "™": "TM", "ﬁ": "fi", "ﬂ": "fl"}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def folded(x: str) -> str:
    """Without accents and compatibility forms; case is kept."""
    for a, b in _LONGER.items():
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return f"strip_accents(translate({x}, {quoted(_WIDE + _SIGNS)}, {quoted(_PLAIN + _FOR)}))"


def small(x: str) -> str:
    return f"replace(lower({folded(x)}), 'ß', 'ss')"


def normalise(x: str) -> str:
    """As ``names.normalise``."""
    bare = f"regexp_replace(replace({small(x)}, '&', ' and '), '[''`‘’´]', '', 'g')"
    return f"trim(regexp_replace({bare}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}]+', ' ', 'g'))"


def ascii_words(x: str) -> str:
    """As ``names.ascii_words``."""
    return f"trim(regexp_replace(regexp_replace(lower(regexp_replace({folded(x)}, '[^\\x00-\\x7f]', '', 'g')), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))"


def crew_key(x: str) -> str:
    """As ``names.crew_key``."""
    quoteless = f"replace(regexp_replace({x}, '[''’]', '', 'g'), '&', ' and ')"
    return f"regexp_replace({ascii_words(quoteless)}, '^the ', '')"


def words(x: str) -> str:
    """A list of the words of an expression parted by blanks."""
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


_ARTICLES = "The|A|An|Le|La|Les|Der|Die|Das|Il|El"


def display_title(x: str) -> str:
    """As ``names.display_title``."""
    pattern = f"'^(.+?), ({_ARTICLES})\\b(.*)$'"
    head, article, tail = (f"regexp_extract({x}, {pattern}, {i}, 's')" for i in (1, 2, 3))
    fits = f"({tail} = '' OR regexp_matches({tail}, '^( - |:| \\()') OR ({article} NOT IN ('A', 'An') AND {tail}[1] = ' '))"
    return f"CASE WHEN {article} <> '' AND {fits} THEN {article} || ' ' || {head} || {tail} ELSE {x} END"


def title_key(x: str) -> str:
    """As ``names.title_key``."""
    base = f"trim(regexp_replace(replace({x}, ' _ ', ' & '), '\\s*[(\\[].*$', '', 's'))"
    return normalise(f"({display_title(f'trim(regexp_replace({base}, {quoted(chr(92) + 's+v' + chr(92) + 'd[' + chr(92) + 'd.]*[a-z]?$')}, {quoted('')}, {quoted('i')}))')})")


def sort_key(x: str) -> str:
    """As ``names.sort_key``."""
    runs = f"regexp_extract_all({normalise(x)}, '(\\p{{Nd}}+|\\P{{Nd}}+)')"
    return f"coalesce(list_aggregate(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^\\p{{Nd}}') THEN lpad(r, greatest(8, length(r))::INTEGER, '0') ELSE r END), 'string_agg', ''), '')"


def sort_title(x: str) -> str:
    """As ``names.sort_title``."""
    shown = display_title(f"trim({x})")
    bare = f"regexp_replace({shown}, '^(?:the|a|an)\\s+(\\S)', '\\1', 'i')"
    return f"coalesce(nullif({sort_key(f'({bare})')}, ''), {sort_key(f'({shown})')})"


def title_words(x: str) -> str:
    """As ``names.title_words``."""
    numerals = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in (("ii", 2), ("iii", 3), ("iv", 4), ("vi", 6), ("vii", 7), ("viii", 8), ("ix", 9)))
    figures = f"list_distinct(list_transform({words(normalise(f'({display_title(x)})'))}, lambda w: CASE w {numerals} ELSE w END))"
    telling = f"list_filter({figures}, lambda w: w NOT IN ('the', 'a', 'an', 'and', 'of'))"
    return f"CASE WHEN len({telling}) > 0 THEN {telling} ELSE {figures} END"


_SIGN = "[\\p{L}\\p{M}\\p{Nd}\\p{Nl}_]"
_NUMERALS = dict(zip("ii iii iv vi vii viii ix xi xii xiii xiv xv xvi".split(), "2 3 4 6 7 8 9 11 12 13 14 15 16".split()))


def tokens(x: str) -> str:
    """As ``names.tokens``, joined by blanks."""
    parted = "regexp_replace(regexp_replace(w, '^(\\p{L}+)(\\p{Nd}+)(\\p{L}?)$', '\\1 \\2 \\3'), '^(\\p{Nd}+)(\\p{L})$', '\\1 \\2')"
    return f"coalesce(list_aggregate(list_transform({words(normalise(x))}, lambda w: trim({parted})), 'string_agg', ' '), '')"


def search_text(x: str) -> str:
    """As ``names.search_text``."""
    joined = f"list_aggregate(list_transform(regexp_extract_all({x}, '{_SIGN}+(?:[-.''/]{_SIGN}+)+'), lambda w: regexp_replace(w, '[-.''/]', '', 'g')), 'string_agg', ' ')"
    return f"trim(concat_ws(' ', {normalise(x)}, {normalise(f'coalesce({joined}, {quoted(str())})')}))"


def title_search_words(x: str) -> str:
    """The words of ``names.title_search_text`` in order of the alphabet."""
    base, own = words(search_text(x)), words(normalise(x))
    swap = " ".join(f"WHEN '{a}' THEN '{b}' WHEN '{b}' THEN '{a}'" for a, b in _NUMERALS.items())
    other = f"list_filter(list_transform({own}, lambda w: CASE w {swap} END), lambda w: w IS NOT NULL)"
    pairs = f"list_filter(list_transform(range(1, greatest(len({own}), 1)), lambda i: ({own})[i] || ({own})[i + 1]), lambda w: NOT regexp_full_match(w, '\\p{{Nd}}+'))"
    extra = f"list_filter(list_distinct(list_concat({other}, {pairs})), lambda w: NOT list_contains({base}, w))"
    return f"CASE WHEN {x} IS NOT NULL THEN coalesce(list_aggregate(list_sort(list_concat({base}, {extra})), 'string_agg', ' '), '') ELSE '' END"


def label(template: str, name: str, number: str, part: str, version: str) -> str:
    """As ``assembly.disc_label`` over a disc's title."""
    part, version = f"coalesce({part}, '')", f"coalesce({version}, '')"
    n = f"{number}::VARCHAR"
    spaced = lambda v: f"CASE WHEN {v} <> '' THEN ' ' || {v} ELSE '' END"
    filled = template
    for slot, value in (("{name}", name), ("{number}", n), ("{number3}", f"lpad({n}, greatest(3, length({n}))::INTEGER, '0')"), ("{part}", part), ("{part_suffix}", spaced(part)), ("{version}", version), ("{version_suffix}", spaced(version))):
        filled = f"replace({filled}, '{slot}', coalesce({value}, ''))"
    title = "coalesce(d.title, '')"
    plain = f"CASE WHEN {part} <> '' AND NOT contains(upper({title}), upper({part})) THEN concat_ws(' ', nullif({title}, ''), {part}) ELSE {title} END"
    return f"coalesce(CASE WHEN {number} IS NOT NULL AND {name} <> '' THEN trim({filled}) END, nullif({plain}, ''), 'Untitled disk')"


def file_words(x: str) -> str:
    """The words of a file name as ``names.file_name_words`` parts it."""
    return f"trim(regexp_replace(lower({x}), '[^0-9a-z]+', ' ', 'g'))"
