"""Queries over whole tables, accented, damaged, look-alike and NULL names among them, against plain loops in Python."""

import re
import unicodedata
from collections import Counter

from diskloom.plans.registry import QUERIES

NAMES = ["Zorblax Soft", "zorblax-soft", "Zörblax Soft", "ZÃ¶rblax Soft", "Zоrblax Sоft", "zorblax-soft", "Ünder & Söhne", "Žár", None, ""]  # the fifth with Cyrillic letters


def run(spark, folder, name):
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).collect()), key=repr)


def save(spark, folder, table, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")


def bare(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def ascii_only(text):
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()


def test_names_of_files(spark, tmp_path):
    names = ["a/Ménü.ST", "plain.st", "дискета", "a\nb.adf", None, ""]
    save(spark, tmp_path, "image_records", list(enumerate(names)), "image_record_id long, name string")
    want = [(i, n.split("/")[-1].lower(), re.sub(r"\.[^.]*$", "", n.split("/")[-1].lower())) for i, n in enumerate(names) if n]
    assert run(spark, tmp_path, "image_file_keys") == sorted(want, key=repr)


def test_spellings_and_rules(spark, tmp_path):
    titles = ["The Quest of Žár", "Тhe Quest of X", "Café Rаlly", "PuzzlÃ© puzzle", "Ménü II", "Menu", None]
    save(spark, tmp_path, "content_records", [(n,) for n in NAMES], "publisher string")
    save(spark, tmp_path, "disk_records", list(enumerate(titles)), "record_id long, title string")
    by = {}
    for n in NAMES:
        if n and (key := re.sub(r"[\W_]+", "", bare(n).replace("&", " and "))):
            by.setdefault(key, Counter())[n] += 1
    want = [(k, *min(((n, c) for n, c in v.items()), key=lambda x: (-x[1], x[0]))) for k, v in by.items()]
    assert run(spark, tmp_path, "common_spellings") == sorted(want, key=repr)
    rules = [("^the .* of ", "quest"), ("(racer|rally|circuit)", "racing"), ("(puzzle|pinball)", "puzzle"), (r"\b(ii|iii|iv|v)$", "sequel")]
    want = [(i, t, next((label for p, label in rules if re.search(p, t or "", re.I)), "")) for i, t in enumerate(titles)]
    assert run(spark, tmp_path, "first_rule_of_titles") == sorted(want, key=repr)


def test_series_and_crews(spark, tmp_path):
    words = lambda t: re.sub("[^a-z0-9]+", " ", ascii_only(t)).strip()
    defs = [("z", "Zorblax Soft", "st"), ("u", "Ünder & Söhne", "st"), ("y", "Zorblax Soft", "amiga")]
    save(spark, tmp_path, "series_defs", defs, "id string, name string, platform string")
    save(spark, tmp_path, "series_alias", [(i, n, "st") for i, n in enumerate(NAMES)] + [(99, "Žár", None)], "alias_id long, alias string, platform string")
    want = [(i, next((k for k, name, p in defs if p == "st" and words(name) == words(n or "")), "")) for i, n in enumerate(NAMES)] + [(99, "")]
    assert run(spark, tmp_path, "lookup_series_names") == sorted(want, key=repr)

    crews = [(i, n, f"s{i}", {"st": i + 1}, "", [f" m{i}", ""], f"n{i}") for i, n in enumerate(NAMES)]
    save(spark, tmp_path, "crew_records", crews, "crew_record_id long, name string, source string, platforms map<string,int>, founded string, members array<string>, notes string")
    save(spark, tmp_path, "disk_records", [(i, n, "st") for i, n in enumerate(NAMES)], "record_id long, cracker string, platform string")
    key = lambda t: words(re.sub("['’]", "", t).replace("&", " and "))
    want = [(i, s, c, "only") for i, n in enumerate(NAMES) if n for c, m, s, *_ in crews if m and key(n) and key(m) == key(n)]
    assert run(spark, tmp_path, "crews_of_records") == sorted(want, key=repr)
    want = [(n, "", "\n\n".join(f"n{i}" for i, m in enumerate(NAMES) if m == n), ", ".join(f"m{i}" for i, m in enumerate(NAMES) if m == n)) for n in {n for n in NAMES if n}]
    assert run(spark, tmp_path, "crews_pooled") == sorted(want, key=repr)


def test_titles(spark, tmp_path):
    rows = [(1, 1, "Zorblax Quest"), (1, 2, "Zörblax Quest"), (1, 3, "ZÃ¶rblax: Quest!"), (1, 4, "Zоrblax"), (1, 5, None), (1, 6, "Žár"), (2, 7, "Žár & Cave & Ménü"), (2, 8, "Žár ＆ Cave"), (None, 9, "Alone & Néar")]
    save(spark, tmp_path, "content_records", rows, "title_id long, content_id long, title string")
    assert run(spark, tmp_path, "fuzzy_title_matches") == [(1, 1, "exact"), (2, 1, "exact"), (7, 7, "exact"), (8, 7, "words")]
    assert run(spark, tmp_path, "titles_joined_by_and") == [(7, "Žár | Cave | Ménü"), (9, "Alone | Néar")]
