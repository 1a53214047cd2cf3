"""Disc images built here byte by byte."""

import gzip
import hashlib
import random

from pyspark.sql import functions as F

from diskloom.functions import images as I
from diskloom.operators import boot as B


def st_image(tracks=80, sides=2, sectors=9, label=b"MY DISC"):
    raw = bytearray(tracks * sides * sectors * 512)
    raw[11:13], raw[14:16], raw[16], raw[17:19] = (512).to_bytes(2, "little"), (1).to_bytes(2, "little"), 2, (112).to_bytes(2, "little")
    raw[19:21], raw[22:24], raw[24:26], raw[26:28] = (tracks * sides * sectors).to_bytes(2, "little"), (5).to_bytes(2, "little"), sectors.to_bytes(2, "little"), sides.to_bytes(2, "little")
    root = 11 * 512
    raw[root : root + 11] = label.ljust(11)
    raw[root + 11] = 8
    return bytes(raw)


def amiga_image():
    raw = bytearray(901_120)
    raw[:4] = b"DOS\1"
    raw[12:20] = b"CODECODE"
    raw[4:8] = I.boot_checksum(bytes(raw[:1024])).to_bytes(4, "big")
    root = 880 * 512
    raw[root : root + 4], raw[root + 508 : root + 512] = (2).to_bytes(4, "big"), (1).to_bytes(4, "big")
    raw[root + 20 : root + 24] = (-3 % (1 << 32)).to_bytes(4, "big")
    return bytes(raw)


def msa(raw, sectors=9, sides=2):
    out = b"\x0e\x0f" + b"".join(n.to_bytes(2, "big") for n in (sectors, sides - 1, 0, len(raw) // (sectors * sides * 512) - 1))
    for at in range(0, len(raw), sectors * 512):
        track = raw[at : at + sectors * 512]
        packed = b"\xe5" + track[:1] + len(track).to_bytes(2, "big") if len(set(track)) == 1 else track
        out += len(packed).to_bytes(2, "big") + packed
    return out


def test_formats_and_geometry():
    st, amiga = st_image(), amiga_image()
    assert I.detect_format(st, "a.st") == I.detect_format(st) == "st" and I.st_geometry(st) == (I.Geometry(80, 2, 9), "boot")
    assert I.detect_format(amiga) == "adf" and I.amiga_geometry(len(amiga)) == I.Geometry(80, 2, 11) and I.amiga_geometry(5) is None
    assert I.detect_format(bytes(901_120), "x.st") == "st" and I.detect_format(st_image(80, 2, 11)) == "st"
    assert I.detect_format(b"DMS!x") == "dms" and I.detect_format(b"") == I.detect_format(b"abc") == "" and I.detect_format(gzip.compress(b""), "a.adz") == "adz"
    assert I.st_geometry(bytes(737_280))[1] in ("size", "guess") and I.st_geometry(bytes(511)) == (None, "")


def test_decoding():
    st, amiga = st_image(), amiga_image()
    assert I.unpack_msa(msa(st)) == (st, I.Geometry(80, 2, 9))
    assert I.decode(gzip.compress(amiga), "a.adz")[:3] == ("adz", "amiga", amiga) and I.decode(gzip.compress(st), "a.st.gz")[0] == "gz"
    kind, _, raw, _, problem = I.decode(msa(st)[:-3], "x.msa")
    assert (kind, raw) == ("msa", None) and problem
    assert I.decode(b"\x1f\x8bxx", "x.gz")[4] and I.decode(b"RSY\0", "x")[4] and I.decode(b"hello", "x")[4] == "not a disc image"
    assert I.volume_label(st) == "MY DISC" and I.volume_label(bytes(2000)) == ""
    scp = bytearray(0x2B0)
    scp[:3], scp[4], scp[5], scp[7] = b"SCP", 0x14, 1, 159
    assert I.decode(bytes(scp), "x.scp") == ("scp", "atari-st", None, I.Geometry(80, 2, 0), "")


def test_boot_sums():
    block = amiga_image()[:1024]
    assert int.from_bytes(block[4:8], "big") == I.boot_checksum(block) and I.root_intact(amiga_image()) and not I.root_intact(bytes(901_120))
    other = bytearray(block)
    other[3] = 0
    assert I.boot_code_crc(block) == I.boot_code_crc(bytes(other))
    sector = bytearray(512)
    sector[:2], sector[0x1E:0x20] = b"\x60\x1c", b"\x4e\x75"
    sector[510:512] = ((0x1234 - I.word_sum(bytes(sector))) & 0xFFFF).to_bytes(2, "big")
    assert I.executable(bytes(sector)) and I.does_nothing(bytes(sector)) and not I.executable(bytes(512))
    assert I.find_patterns(b"\0AB\0AB", 0, [("even", b"AB", True), ("any", b"AB", False), ("no", b"ZZ", False)]) == ["even", "any"]


def test_inspection(spark):
    st, amiga = st_image(), amiga_image()
    rows = [(1, "a.st", st), (2, "b.adf", amiga), (3, "c.msa", msa(st)), (4, "d.dms", b"DMS!rest"), (5, "e.st", None), (6, None, b"")]
    df = spark.createDataFrame(rows, "id int, name string, content binary").select("id", I.inspect_image(F.col("content"), F.col("name")).alias("i"), I.image_format(F.col("content"), F.col("name")).alias("f"))
    got = {r.id: r for r in df.collect()}
    assert got[1].i.label == "MY DISC" and got[3].i.raw_md5 == got[1].i.raw_md5 == hashlib.md5(st).hexdigest() and got[3].i.geometry_from == "hint"
    assert got[2].i.platform == "amiga" and got[2].i.boot_valid and got[2].i.root_intact and got[2].i.boot_runs and bytes(got[2].i.boot) == amiga[:1024]
    assert got[4].f == "dms" and got[4].i.problem and got[5].i.format == got[6].i.format == "" and got[5].i.raw_size is None


def test_boot_classes(spark):
    rnd = random.Random(1)
    code = bytes(rnd.randrange(256) for _ in range(1024))
    rows = [(1, code, 11, True, True), (2, b"XX" + code[2:], 12, True, True), (3, b"ab" + bytes(1022), 13, True, True), (4, bytes(1024), 14, True, False), (5, None, None, None, None), (6, b"abcd" + bytes(1020), 15, True, True), (7, b"zz" + bytes(1022), 99, True, True)]
    blocks = spark.createDataFrame([(i, "amiga", b, c, v, r, False) for i, b, c, v, r in rows], "id int, platform string, boot binary, boot_crc long, boot_valid boolean, boot_runs boolean, does_nothing boolean")
    sig = lambda name, o, n, ord: (ord, name, o, n, hashlib.sha1(code[o : o + n]).hexdigest())
    signatures = spark.createDataFrame([sig("late", 8, 64, 2), sig("first", 16, 32, 1), (0, "bad", 1000, 100, "x")], "ord int, name string, offset int, length int, sha1 string")
    assert B.valid_signatures(signatures, 1024).count() == 2
    markers = spark.createDataFrame([("one", 0, "6162"), ("two", 0, "6162"), ("two", 2, "6364")], "name string, offset int, bytes string")
    filed = spark.createDataFrame([(99, "Loader", "s")], "boot_crc long, name string, class string")
    got = {r.id: (r.status, r.name, r.source) for r in B.classify(blocks, B.valid_signatures(signatures, 1024), markers, filed).collect()}
    assert got == {1: ("virus", "first", "signature"), 2: ("virus", "first", "signature"), 3: ("virus", "one", "marker"), 4: ("inactive", "", ""), 5: ("damaged", "", ""), 6: ("unknown", "", ""), 7: ("known", "Loader", "filed")}


def test_longest_prefix(spark):
    rows = spark.createDataFrame([("Gremlin Eater 2",), ("Gremlins",), ("gremlin",), (None,)], "n string")
    kinds = spark.createDataFrame([("Gremlin", "link"), ("Gremlin Eater", "boot")], "prefix string, kind string")
    assert {r.n: r.kind for r in B.longest_prefix(rows, "n", kinds).collect()} == {"Gremlin Eater 2": "boot", "Gremlins": None, "gremlin": "link", None: None}
