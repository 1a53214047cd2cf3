"""Records across sources, leaked evaluation texts, stuffed pages."""

import random

import pytest
from pyspark.sql import functions as F

cross = pytest.importorskip("diskloom.llm.crossmatch")
leakage = pytest.importorskip("diskloom.llm.leakage")
spam = pytest.importorskip("diskloom.llm.spam")


def test_parts_of_records():
    assert cross.parse_title("The Lost Quest of Grunavel III (Disk 2 of 2)") == (["lost", "quest", "grunavel"], 3, 2)
    assert cross.parse_title("Quest o' Grunavel [cr]") == (["quest", "grunavel"], 1, 0) and cross.parse_title(None) == ([], 1, 0)
    assert cross.publisher_core("Grunavel Entertainment GmbH") == cross.publisher_core("gRUNAVEL eNT.") == cross.publisher_core("Soft Grunavel") == "grunavel"
    assert cross.publisher_core("unknown") == cross.publisher_core(None) == cross.publisher_core("Gru…") == ""
    assert cross.checksum("0xABCD-0123") == "abcd0123" and cross.checksum("00000000") == cross.checksum("xyz") == cross.checksum(None) == ""
    assert (cross.year_of("1990-xx"), cross.year_of("198x"), cross.year_of(None)) == (1990, 0, 0)
    assert cross.part_number("A") == cross.part_number("1") == cross.part_number("Disk 1") == 1 and cross.part_number(None) == 0


def matches(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "record_id long, source string, platform string, part string, title string, date_text string, publisher string, checksums array<string>, node string")
    return {(r.record_a, r.record_b) for r in cross.cross_source_pairs(df).collect()}


def test_cross_source(spark):
    rows = [
        (1, "a", "st", "", "Quest of Grunavel", "1990", "Brazoplik Soft", ["aaaaaaa1"]), (2, "b", "st", "", "quest_of_grunavl", "1990-05", "Brazoplk Software", []), (2, "b", "st", "", "quest_of_grunavl", "1990-05", "Brazoplk Software", []),
        (3, "c", "st", "", "Quest of Grunavel", "", "unknown", ["AAAAAAA1"]),  # by its checksum
        (4, "c", "amiga", "", "Quest of Grunavel", "1990", "Brazoplik Soft", []),  # another platform
        (5, "c", "st", "", "Quest of Grunavel II", "1990", "Brazoplik Soft", []),  # a follow-up
        (6, "d", "st", "A", "Quest of Grunavel", "1990", "Brazoplik Soft", []), (7, "e", "st", "1", "Quest of Grunavel", "1990", "Brazoplik", []),  # a part
        (8, "d", "st", "", "Quest of Grunavel", "1996", "Wimpofax Games", []), (9, "e", "st", "", "Quest of Grunavel", "1996", None, []),  # another release
        (10, "a", "st", "", None, None, None, None), (11, "b", "st", "", "", "", "", []), (None, "x", "st", "", "Quest of Grunavel", "", "", []), (12, "a", None, "", "Lone Title", "", "", []),
    ]
    assert matches(spark, rows) == {(1, 2), (1, 3), (2, 3), (6, 7), (8, 9)}
    assert matches(spark, []) == set()


def test_nearest_in_both_directions(spark):
    rows = [(1, "a", "st", "", "Quest of Grunavel", "1990", "Brazoplik", []), (2, "b", "st", "", "Quest of Grunavel", "1990", "Brazoplik", []), (3, "a", "st", "", "Quest of Grunavel", "1990", None, [])]
    rows += [(4, "c", "st", "", "Quest of Grunavel", "", None, [])]
    assert matches(spark, rows) == {(1, 2), (1, 4), (2, 4)}  # 3 is of a source that has a nearer record


def test_bm25_of_releases(spark):
    rows = [(r, f"s{r}", t, y, p, c) for r, t, y, p, c in [(1, 7, 1990, "bra", ["aa"]), (2, 7, 1990, "bra", ["aa"]), (3, 7, 1995, "wim", ["bb"]), (4, 7, 1995, "wim", []), (5, 7, 0, None, ["aa"]), (6, 7, 1994, None, []), (7, 7, 0, None, [])]]
    df = spark.createDataFrame(rows, "record_id long, source string, title long, year int, publisher string, checksums array<string>").withColumn("release", F.when(F.col("publisher") == "bra", 1).when(F.col("publisher") == "wim", 2)).withColumn("sums", F.size("checksums"))
    index = cross.ReleaseIndex(df, spark.createDataFrame([("aa", 2.0), ("bb", 2.0)], "checksum string, w double"))
    got = {r.record_id: r for r in index.ranked(df.where("release IS NULL").withColumn("own", F.lit(None).cast("long"))).collect()}
    assert (got[5].release, got[6].release) == (1, 2) and got[5].gap > 0 and got[5].shared and got[7].tied and got[7].gap == 0

    def part(tf, size, w):  # by hand, over two releases of five and four terms
        return w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / 5.5))

    assert abs(got[5].score - part(2, 6, 2.0)) < 1e-9
    hidden = {r.record_id: r for r in index.ranked(df.where("release = 1").withColumn("own", F.col("release"))).collect()}
    assert hidden[1].release == 1 and hidden[1].score < part(2, 6, 2.0) + 10  # what it gave itself is left out


def test_logistic():
    rnd = cross.np.random.default_rng(3)
    x = cross.np.column_stack([cross.np.ones(4000), rnd.normal(size=4000)])
    y = (rnd.random(4000) < 1 / (1 + cross.np.exp(-(0.5 + 2 * x[:, 1])))).astype(float)
    assert abs(cross.logistic(x, y) - [0.5, 2]).max() < 0.2


def test_many_publishers_of_one_title(spark, monkeypatch):
    names = ["brazoplik", "brazoplk", "wimpofax", "wimpofx", "wimp", "grunavel", "zar"]
    rows = spark.createDataFrame([(1, n) for n in names] + [(2, "zar"), (2, None)], "title long, publisher string")
    few = {(r.title, r.publisher): r.release for r in cross._releases(rows).collect()}
    monkeypatch.setattr(cross, "MOST_SPELLINGS", 2)
    many = {(r.title, r.publisher): r.release for r in cross._releases(rows).collect()}
    assert few == many and len(set(few.values())) == 5 and few[1, "wimp"] == few[1, "wimpofx"]


def test_digits_and_long_words():
    assert cross.part_number("12345678901") == 12345678901 and cross.parse_title("Quest 1000000")[0] == ["quest", "1000000"]
    assert cross.common_words({"odyssey": 77, "odysseyof": 8, "tunnel": 60, "funnel": 50, "tunel": 9, "teh": 20}) == ["funnel", "odyssey", "tunnel"]


def test_checksums_tell_by_titles_not_records(spark):
    hot = [(i, f"s{i}", "st", "", "Quest of Grunavel", "1990", None, ["aaaaaaa1"]) for i in range(1, 20)]  # more records than any fixed number
    rows = [(20, "x", "st", "", "Quast of Gronafil", "1990", None, ["aaaaaaa1"])]  # alike by its checksum only
    rows += [(21, "x", "st", "", "Quest of Grunavel", "1990", "Brazoplik", ["aaaaaaa1"]), (22, "y", "st", "", "Quest of Grunavel", "1990", "Wimpofax", ["bbbbbbb1"])]
    assert matches(spark, hot + rows) == {(i, j) for i in range(1, 22) for j in range(i + 1, 22)} - {(20, 21)}
    names = ["Vumbrelac", "Vamprelic", "Zorblaxig", "Krintofal", "Plodimert"]
    junk = [(i, f"s{i}", "st", "", n, "", None, ["ccccccc1"]) for i, n in enumerate(names)]  # few records, but unrelated titles
    assert matches(spark, junk) == set()


def test_title_terms_find_all_pairs():
    rnd = random.Random(5)
    fixer = cross.WordFixer(["tunnel", "funnel", "valley", "volley", "quest", "magnificently", "magnet", "magic"])
    known = frozenset(fixer.common)
    pool = ["tunnel", "funnel", "runnel", "valley", "vlley", "quest", "flogucit", "flogukit", "floguc.", "mag.", "magnetik", "zorblaxigunavel", "zorblxigunavl", "magnificntlyx", "flo.", "vall.", "extraordinaryword", "extrordinarywrd"]
    found = 0
    for _ in range(4000):
        a = sorted(set(rnd.choices(pool, k=rnd.randrange(1, 4))))
        b = sorted(set(rnd.choices(pool, k=len(a))))
        if not cross.same_title(a, b, known):
            continue
        x, y = ({t[:2] for t in cross.title_terms(w, fixer)} for w in (a, b))
        whole = {t for t, c in x if "^" not in t} & {t for t, c in y if "^" not in t}
        short = {t for t, c in x if c} & {t for t, _ in y} | {t for t, c in y if c} & {t for t, _ in x}
        found += a != b
        assert whole or short, (a, b)
    assert found > 100


def test_unsettled_words(spark):
    common = [(100 + i, "z", "st", "", f"{w} {o}", "", "", []) for i, (w, o) in enumerate((w, o) for w in ("tunnel", "funnel") for o in ("Abrakos", "Brimuvel", "Cadrifan"))]
    rows = [(1, "a", "st", "", "Flogucit tunnel", "1990", "Brazoplik", []), (2, "b", "st", "", "Flogucit runnel", "1990", "Brazoplik", []), (3, "c", "st", "", "Zorblaxigunavel tunnel", "1990", "", []), (4, "d", "st", "", "Zorblxigunavl runnel", "1990", "", [])]
    assert matches(spark, rows + common) == {(1, 2), (3, 4)}


ITEM = "According to Brenuvat the copper list repaired by Skolimap needed eleven revolutions since two testers refused the format while every courier from Lindhag kept jamming the third loading picture before the annual heat wave"
OTHER = "Why was the sprite table of Domaxil swapped in one wet summer fair although nobody else asked for fewer colours and the typist needed a ladder to reach the second printed map of Ostermoor"


def leaks(spark, docs, items=((1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "zin"))):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    return {tuple(r)[:2] for r in leakage.leaked_items(d, spark.createDataFrame(list(items), "item_id long, text string")).collect()}


def test_leaks(spark):
    w = ITEM.split()
    docs = [
        (1, f"before {ITEM} after"), (2, "<b>" + ITEM.upper().replace(" ", " </b>&nbsp;<i>") + "</i>"), (3, ITEM.replace("e", "е").replace("o", "ó")),
        (4, " ".join(w[:10]) + " other matter. " + " ".join(w[10:20])), (5, " ".join(w[:8])),  # a short quotation
        (6, " ".join(x if i % 7 else "changed" for i, x in enumerate(w))), (7, " ".join(w[::-1])), (8, " ".join(w[17:] + w[:17])), (9, None), (10, ""), (11, "x " * 50_000 + ITEM + " y" * 50_000),
        (12, ITEM.replace("repaired", "re­pai​red").replace("Lindhag", "Lind-\nhag")), (13, "zin"), (1, f"before {ITEM} after"), (None, ITEM), (14, ITEM + " " + OTHER),
    ]
    assert leaks(spark, docs) == {(i, 1) for i in (1, 2, 3, 4, 6, 8, 11, 12, 14)} | {(13, 5), (14, 2)}
    assert leaks(spark, []) == set() and leaks(spark, docs, []) == set()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = leakage.leaked_items(d, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert {r.doc_id for r in leakage.without_leaks(d, found).collect()} == {5, 7, 9, 10, 13, None}


def test_leaks_with_every_fifth_or_fourth_word_changed(spark):
    docs = [(n, " ".join(x if i % n else f"changed{i}" for i, x in enumerate(ITEM.split()))) for n in (2, 3, 4, 5)]
    assert leaks(spark, docs) == {(4, 1), (5, 1)}


def test_places_of_leaks(spark):
    w = ITEM.split()
    d = spark.createDataFrame([(1, "some words before " + " ".join(w[:12]) + " and between " + " ".join(w[15:30]))], "doc_id long, text string")
    (row,) = leakage.leaked_items(d, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()
    assert [tuple(x) for x in row.passages] == [(3, 0, 12), (17, 15, 15)] and abs(row.share - 27 / len(w)) < 1e-9


def test_chains_against_brute_force():
    rnd = random.Random(8)
    for _ in range(300):
        rows = sorted({(rnd.randrange(12), rnd.randrange(12), rnd.randrange(3, 6)) for _ in range(rnd.randrange(1, 8))})
        best = [n for _, _, n in rows]
        for k, (p, j, n) in enumerate(rows):
            for m in range(k):
                q, i, size = rows[m]
                if q < p and i < j and (gain := n - max(0, q + size - p, i + size - j)) > 0:
                    best[k] = max(best[k], best[m] + gain)
        assert leakage.chained(leakage.np.array(rows))[0] == max(best)


def test_blocks_and_shards_change_nothing(spark, monkeypatch):
    docs = [(i, f"{i} {ITEM if i % 3 else OTHER} {i}") for i in range(12)]
    whole = leaks(spark, docs)
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 10)
    assert leaks(spark, docs) == whole and len(whole) == 12


def test_suffix_search_against_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        text = lambda n: " ".join(rnd.choice("abcd") for _ in range(n))
        items = [(i, text(rnd.randrange(1, 12))) for i in range(4)]
        index = leakage.ItemIndex(items, 5)
        docs = [(j, [index.numbers.get(w, 0) for w in text(rnd.randrange(0, 30)).split()]) for j in range(5)]
        got = index.candidates(docs)
        for j, words in docs:
            for i, own in index.items.items():
                n = min(5, len(own))
                want = {p + k for p in range(len(own) - n + 1) for q in range(len(words) - n + 1) if own[p : p + n] == words[q : q + n] for k in range(n)}
                assert got.get((j, i), set()) == want, (own, words)


GENUINE = [
    "Passwords for Zork\n" + "\n".join(f"Level {i:02d}: {i * 7919 % 99991}XQ" for i in range(30)),
    "\n".join(f"  move.w\t#${i * 977 % 65536:04x},d{i % 8}\t; sample player" for i in range(40)),
    "Our greetings go to\n" + "\n".join(["Bovnezer & Loxrebar", "Krarzalar Bomrizip"] * 12),
    "TITLE      TYPE     DISK\n" + "\n".join(f"Lost Quest {i}     menu    {i}" for i in range(40)),
    "never stop the music, never stop the music, " * 20,
    "The loader is credited to Zapel. " * 9 + "\nSee also:\n" + "\n".join(f"https://quest-pack{i}.example/menu/{i}" for i in range(4)),
    "", "   \n", "WAIT WAIT WAIT! " * 10,
]
STUFFED = [
    "boot sector torrent, boot sector rom, disc swap free, sound chip download, " * 12,
    "\n".join(f"http://www.quest{i}.example/rom/{i}.html" for i in range(20)),
    "<ul>" + "".join(f'<li><a href="//maze{i}.example/{i}">free bonus level</a></li>' for i in range(15)) + "</ul>",
    " ".join(f"#lostquest{i}free" for i in range(30)),
    "\n".join(f"Lost Quest {i} online EUR {i}.50 add to basket tags: pack, free" for i in range(20)),
    "Buy disc swap, sell disc swap, swap disc swap with disc swap people. Why disc swap? Because disc swap is disc swap. disc swap disc swap disc swap! " * 6,
    " | ".join(f"download Lost Quest {i}" for i in range(40)),
    "  ".join(f"maze-menu{i}.example" for i in range(40)),
]


def test_stuffed_pages(spark):
    docs = [(i, t) for i, t in enumerate(GENUINE)] + [(100 + i, t) for i, t in enumerate(STUFFED)] + [(300, None), (100, STUFFED[0]), (None, STUFFED[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("stuffed_share", F.lit("clash"))
    assert {r.doc_id for r in spam.stuffed_pages(df).collect()} == {100 + i for i in range(len(STUFFED))}
    assert spam.stuffed_pages(df.limit(0)).count() == 0
    assert spam.stuffing("The odd part about this disc is how the loader keeps time. " * 30)[0] == 0


def test_repeated_tokens_against_brute_force():
    rnd = random.Random(2)
    for _ in range(3000):
        t = [rnd.choice("abcdef"[: rnd.randrange(1, 7)]) for _ in range(rnd.randrange(14))]
        two = [tuple(t[i : i + 2]) for i in range(len(t) - 1)]
        want = [any(0 <= k < len(two) and two.count(two[k]) > 1 for k in (i - 1, i)) for i in range(len(t))]
        assert spam.repeated(t, 2)[0] == want, t
        assert spam.repeated(t, 2, 3, 4.2) == spam.repeated_in_long(t, 2, 3, 4.2), t


def test_stuffing_in_invented_words():
    rnd = random.Random(3)
    words = "lamp desk chair oak walnut brass vintage modern rug sofa shelf mirror".split()
    assert spam.stuffing(" ".join(rnd.choice(words) for _ in range(300)))[0] == 1
    assert spam.stuffing(", ".join(f"vintage {w}" for w in words))[0] == 1
    assert spam.stuffing("Greetings to Zorb, Kelvak of Munti, The Dralo Crew, Pim, Sarn and Tolk, Brix, Mog, Vantor, Ulma, Rix")[0] == 0
    assert spam.stuffing("The lamp stands in the hall. We bought it in spring, and it has never failed us since. The desk came later.")[0] == 0
    assert spam.stuffing("\n".join(f"http://shop{i}.store/x" for i in range(9)))[0] == 1 and spam.stuffing("\n".join(f"file{i}.adf 901120" for i in range(9)))[0] == 0


def test_long_pages_are_measured_alike(monkeypatch):
    page = "\n".join(STUFFED + GENUINE)
    whole = spam.stuffing(page)
    monkeypatch.setattr(spam, "LONG_PAGE", 10)
    assert spam.stuffing(page) == whole
