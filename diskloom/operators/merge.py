"""Merging records of many sources into discs: by key, by dump hash and by address, in order of trust.

The rules depend on order: a record goes to what earlier records made. They only ever look up keys that records share,
so records that share none, directly or through others, cannot influence each other. The merge therefore labels groups
of records that share keys, and runs the ordered rules within each group in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diskloom.functions import names as N
from diskloom.operators.skew import lookup_join
from diskloom.session import cut
from diskloom.sources.files import hash_keys

RECORDS = (
    "record_id long, source string, priority int, seq long, platform string, kind string, series_key string, number int, part string, version string, title string, attach_only boolean, "
    "n_contents int, n_media int, images array<struct<name:string,md5:string,sha1:string,sha512:string,crc32:string,size:bigint>>, "
    "locations array<struct<url:string,member:string,image_name:string,hash_kind:string,hash_value:string,size:bigint>>"
)


#: So many edges are settled by one task; more go through rounds.
TASK_EDGES = 2_000_000


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The groups of the edges of one task: each node with the smallest it is connected to there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for x, y in zip(b["a"].tolist(), b["b"].tolist()):
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    for i in range(0, len(nodes), 100_000):
        yield pd.DataFrame([(root(x), x) for x in nodes[i : i + 100_000]], columns=["a", "b"])


def label_groups(edges: DataFrame, most_rounds: int = 40, *, task_edges: int = TASK_EDGES) -> DataFrame:
    """``node, label``: each node of ``edges`` (bigint ``a``, ``b``) with the smallest node it is connected to.

    Up to ``task_edges`` edges are settled by one task. More are first reduced by each task to a forest of stars, then
    two steps alternate until no pair changes: every node passes its smallest neighbour to its larger neighbours, then
    to its smaller ones. Chains halve with each round. Hot nodes are joined as ``lookup_join`` does; rounds are cut by
    checkpoints.
    """
    given = cut(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if given.count() <= task_edges:
        return given.coalesce(1).mapInPandas(_settle, "a long, b long").select(F.col("b").alias("node"), F.col("a").alias("label"))
    alone = given.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("label"))
    pairs = cut(given.where("a < b").mapInPandas(_settle, "a long, b long").where("a < b").distinct())
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = lookup_join(both, least, "a", "inner").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy(F.col("b").alias("k")).agg(F.min("a").alias("m"))
        small = lookup_join(large.select(F.col("b").alias("k"), "a"), least, "k", "inner")
        out = small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(small.select(F.col("m").alias("a"), F.col("k").alias("b"))).where("a < b").distinct()
        before, pairs = pairs, cut(out)
        if pairs.count() == before.count() and pairs.join(before, ["a", "b"], "left_anti").isEmpty():
            break
    else:
        raise RuntimeError(f"groups did not settle in {most_rounds} rounds")
    labels = pairs.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()
    return labels.unionByName(alone.join(labels, "node", "left_anti"))


def merge_key(series: Column, number: Column, part: Column, version: Column) -> Column:
    """The key of a numbered disc, NULL without series or number; parts and versions in one spelling."""
    spelled = F.regexp_replace(N.normalise_version(version), r"(?:\.0+)+$", "")
    return F.when((series != "") & number.isNotNull(), F.concat_ws("\x1f", series, number.cast("string"), N.normalise_part(part), spelled))


def _phase(r: Column) -> Column:
    """What kind of record it is; the phases run in this order: 0 keyed, 1 with dumps, 2 plain, 3 attached by key only, 4 a titled download, 5 others (placed afterwards)."""
    has = lambda a: F.size(F.coalesce(a, F.array())) > 0
    names = F.exists(F.col("locations"), lambda x: (F.coalesce(x["image_name"], F.lit("")) != "") | (F.coalesce(x["member"], F.lit("")) != "") | (F.coalesce(x["hash_value"], F.lit("")) != ""))
    only_locations = has(F.col("locations")) & (F.col("n_contents") == 0)
    return (
        F.when(r.isNotNull() & F.col("attach_only"), 3).when(r.isNotNull(), 0).when(has(F.col("images")), 1)
        .when(only_locations, F.when((F.trim("title") != "") & ~names, 4).otherwise(5)).when((F.col("n_contents") == 0) & (F.col("n_media") > 0), 5).otherwise(2)
    )


def _number(record: dict) -> int | None:
    if record["number"] is not None:
        return record["number"]
    found = re.findall(r"\d+", record["title"] or "")
    return int(found[-1]) if found else None


class Group:
    """The ordered rules over the records of one group."""

    def __init__(self, first_owner: dict[str, str]):
        self.first_owner = first_owner  # hash keys of several keyed discs, known beforehand, with the key of the first
        self.discs: list[dict] = []
        self.keyed: dict[str, dict] = {}
        self.owner: dict[str, tuple[dict, int]] = {}
        self.shared: set[str] = set(first_owner)
        self.by_url: dict[str, dict] = {}

    def disc(self, record: dict) -> dict:
        new = {"id": record["record_id"], "platform": record["platform"], "number": record["number"] if record["key"] else None, "key": record["key"], "records": [], "images": []}
        self.discs.append(new)
        return new

    def by_hash(self, record: dict) -> dict | None:
        for keys in record["image_keys"]:
            for k in keys:
                if k not in self.shared and k in self.owner and self.owner[k][0]["platform"] == record["platform"]:
                    return self.owner[k][0]
        return None

    def by_address(self, record: dict) -> dict | None:
        for url in record["urls"]:
            disc = self.by_url.get(url)
            if disc is None or disc["platform"] != record["platform"]:
                continue
            theirs = _number(record)
            ours = disc["number"] if disc["number"] is not None else next((n for r in disc["records"] if (n := _number(r)) is not None), None)
            if theirs is None or ours is None or ours == theirs:
                return disc
        return None

    def owns(self, key: str, disc: dict) -> bool:
        """Whether ``disc`` is or may become the owner of a hash key."""
        return key not in self.first_owner or self.first_owner[key] == disc["key"]

    def register(self, disc: dict, image: int) -> None:
        for k in disc["images"][image]["keys"]:
            held = self.owner.get(k)
            if held is None:
                if self.owns(k, disc):
                    self.owner[k] = (disc, image)
            elif held[0] is not disc:
                self.shared.add(k)

    def add(self, disc: dict, record: dict) -> list[int]:
        """Put a record and its dumps on a disc; the place of each dump among the disc's."""
        disc["records"].append(record)
        places = []
        for keys, names in zip(record["image_keys"], record["image_names"]):
            at = next((self.owner[k][1] for k in keys if k in self.owner and self.owner[k][0] is disc), None)
            if at is None and not keys:
                at = next((i for i, x in enumerate(disc["images"]) if set(names) & x["names"]), None)
            elif at is not None:
                disc["images"][at]["keys"] += [k for k in keys if k.split(":", 1)[0] not in {x.split(":", 1)[0] for x in disc["images"][at]["keys"]}]
            if at is None:
                disc["images"].append({"keys": list(keys), "names": set(names)})
                at = len(disc["images"]) - 1
            if keys:
                self.register(disc, at)
            places.append(at)
        for url in record["urls"]:
            self.by_url.setdefault(url, disc)
        return places

    def run(self, records: list[dict]) -> Iterator[tuple[int, int | None, str, list[int]]]:
        """(record, disc, way, places of its dumps) of every record."""
        for r in sorted(records, key=lambda r: (r["phase"], r["seq"])):
            phase = r["phase"]
            disc, way = None, "new"
            if phase in (0, 3):
                disc, way = self.keyed.get(r["key"]), "key"
                if disc is None and phase == 3:
                    yield r["record_id"], None, "dropped", []
                    continue
            elif phase == 1:
                disc, way = self.by_hash(r), "hash"
            if disc is None and phase in (1, 2, 4):
                disc, way = self.by_address(r), "address"
            if disc is None:
                disc, way = self.disc(r), "new"
                if r["key"]:
                    self.keyed[r["key"]] = disc
            yield r["record_id"], disc["id"], way, self.add(disc, r)


def _run_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs the rules over rows sorted by group; a group may span batches, groups need no call of their own."""

    def done(records: list[dict], owners: dict[str, str]) -> list[tuple]:
        return list(Group(owners).run(records))

    label, held, owners = None, [], {}
    for b in batches:
        out: list[tuple] = []
        for t in b.itertuples(index=False):
            if t.label != label:
                out += done(held, owners)
                label, held, owners = t.label, [], {}
            if t.owners is not None:
                owners.update(tuple(pair) for pair in t.owners)
            held.append(
                {
                    "record_id": t.record_id, "platform": t.platform, "number": None if pd.isna(t.number) else int(t.number), "title": t.title, "seq": t.seq, "phase": t.phase,
                    "key": t.key if isinstance(t.key, str) else None, "image_keys": [list(k) for k in t.image_keys], "image_names": [list(k) for k in t.image_names], "urls": list(t.urls),
                }
            )
        yield pd.DataFrame(out, columns=["record_id", "disc", "way", "images"]).astype({"disc": "Int64"})
    yield pd.DataFrame(done(held, owners), columns=["record_id", "disc", "way", "images"]).astype({"disc": "Int64"})


def merge_records(records: DataFrame) -> DataFrame:
    """Which disc each record belongs to: ``record_id, disc, way, images``.

    ``records`` as in RECORDS; ``seq`` orders them by trust. ``disc`` is the record that made the disc; ``way`` is new,
    key, hash, address, dropped (attached by a key that no record made) or later (records that only point at dumps or
    titles, which are joined to the finished discs). ``images`` gives the place of each of the record's dumps among
    the disc's, so dumps that are one have one place.

    A hash that dumps of several keyed discs share can join nothing; those hashes are found by one aggregation and
    taken out before groups are labelled, so a checksum that very many records share makes no giant group.
    """
    images, locations = F.coalesce("images", F.array()), F.coalesce("locations", F.array())
    keyed = records.withColumn("key", merge_key(F.coalesce("series_key", F.lit("")), F.col("number"), F.coalesce("part", F.lit("")), F.coalesce("version", F.lit(""))))
    keyed = keyed.withColumn("phase", _phase(F.col("key")))
    text = lambda x: F.coalesce(x, F.lit(""))
    rows = keyed.select(
        "record_id", "platform", "number", "title", "seq", "key", "phase",
        F.transform(images, lambda i: hash_keys(text(i["md5"]), text(i["sha1"]), text(i["sha512"]), text(i["crc32"]), i["size"])).alias("image_keys"),
        F.transform(images, lambda i: N.image_name_keys(text(i["name"]))).alias("image_names"),
        F.transform(F.filter(locations, lambda x: (text(x["image_name"]) == "") & (text(x["member"]) == "") & (text(x["hash_value"]) == "") & (text(x["url"]) != "")), lambda x: N.url_key(x["url"])).alias("urls"),
    )
    rows = cut(rows)
    later = rows.where("phase = 5").select("record_id", F.lit(None).cast("long").alias("disc"), F.lit("later").alias("way"), F.array().cast("array<int>").alias("images"))
    rows = rows.where("phase < 5")
    hashes = rows.select("record_id", "key", "seq", "phase", F.explode(F.array_distinct(F.flatten("image_keys"))).alias("k"))
    shared = hashes.where("phase = 0").groupBy("k").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.min(F.struct("seq", "key"))["key"].alias("owner")).where("lo < hi").select("k", "owner")
    links = (
        rows.where("key IS NOT NULL").select("record_id", F.concat(F.lit("key:"), "key").alias("k"))
        .unionByName(hashes.join(shared, "k", "left_anti").select("record_id", F.concat(F.lit("hash:"), "k").alias("k")))
        .unionByName(rows.select("record_id", F.explode(F.array_distinct("urls")).alias("k")).select("record_id", F.concat(F.lit("url:"), "k").alias("k")))
    )
    links = cut(links)
    firsts = links.groupBy("k").agg(F.min("record_id").alias("a"))
    edges = lookup_join(links, firsts, "k", "inner").select("a", F.col("record_id").alias("b"))
    labels = label_groups(edges)
    owners = hashes.join(shared, "k").groupBy("record_id").agg(F.collect_set(F.array("k", "owner")).alias("owners"))
    grouped = rows.join(labels.select(F.col("node").alias("record_id"), "label"), "record_id", "left").withColumn("label", F.coalesce("label", "record_id")).join(owners, "record_id", "left")
    done = grouped.repartition("label").sortWithinPartitions("label", "seq").mapInPandas(_run_groups, "record_id long, disc long, way string, images array<int>")
    return done.unionByName(later)


def place_locations(locations: DataFrame, images: DataFrame) -> DataFrame:
    """The dump that each location points at: ``location_id, image_id``; locations that match nothing have no row.

    ``locations``: location_id, hash_kind, hash_value, size, name; ``images``: image_id, ord, name, md5, sha1, sha512,
    crc32, size. A location with a hash goes only to a dump with that hash (a CRC also needs the size where the
    location gives one), others go by file name, with or without its extension. The first dump by ``ord`` wins.
    """
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    values = images.select("image_id", "ord", "size", F.explode(F.array_compact(F.array(*(F.when(text(h) != "", F.concat(F.lit("crc:" if h == "crc32" else ""), text(h))) for h in ("md5", "sha1", "sha512", "crc32"))))).alias("v"))
    hashed = locations.where(text("hash_value") != "").withColumn("v", F.concat(F.when(text("hash_kind").isin("crc", "crc32"), "crc:").otherwise(""), text("hash_value")))
    by_hash = hashed.select("location_id", "v", F.col("size").alias("want")).join(values, "v").where(~F.col("v").startswith("crc:") | F.col("want").isNull() | (F.col("want") == F.col("size")))
    named = locations.where((text("hash_value") == "") & (text("name") != "")).select("location_id", F.posexplode(N.image_name_keys(F.col("name"))).alias("way", "n"))
    by_name = named.join(images.select("image_id", "ord", F.explode(N.image_name_keys(F.col("name"))).alias("n")), "n")
    first = lambda df, *order: df.groupBy("location_id").agg(F.min(F.struct(*order, "image_id"))["image_id"].alias("image_id"))
    return first(by_hash, "ord").unionByName(first(by_name, "way", "ord"))


def resolve_crews(discs: DataFrame, crews: DataFrame, credits: DataFrame, pins: DataFrame, *, least_share: float = 0.9, least: int = 10) -> DataFrame:
    """The record of each source that describes each disc's crew: ``disk_id, source, crew_record_id, way``.

    ``discs``: disk_id, crew, platform; ``crews``: crew_record_id, name, source, platform, releases (one row for each
    platform); ``credits``: disk_id, crew_record_id; ``pins``: key, platform, source, crew_record_id. Of a source's
    records of the disc's crew name and platform the credited one is taken, else the only one, else the pinned one,
    else the one with most of their releases there; otherwise none, as the name is ambiguous.
    """
    found = discs.withColumn("key", N.crew_key(F.col("crew"))).where("key <> ''").join(crews.withColumn("key", N.crew_key(F.col("name"))), ["key", "platform"])
    found = found.join(credits.withColumn("credited", F.lit(True)), ["disk_id", "crew_record_id"], "left").join(pins.withColumn("pinned", F.lit(True)), ["key", "platform", "source", "crew_record_id"], "left")
    by = found.groupBy("disk_id", "source").agg(
        F.min(F.when(F.col("credited"), F.col("crew_record_id"))).alias("c"), F.count(F.lit(1)).alias("n"), F.min("crew_record_id").alias("one"), F.min(F.when(F.col("pinned"), F.col("crew_record_id"))).alias("p"),
        F.min(F.struct((-F.col("releases")).alias("m"), "crew_record_id")).alias("top"), F.sum("releases").alias("total"),
    )
    enough = (-F.col("top.m") >= least) & (-F.col("top.m") >= least_share * F.col("total"))
    pick = F.when(F.col("c").isNotNull(), F.struct(F.lit("credited").alias("way"), F.col("c").alias("id"))).when(F.col("n") == 1, F.struct(F.lit("only").alias("way"), F.col("one").alias("id")))
    pick = pick.when(F.col("p").isNotNull(), F.struct(F.lit("pinned").alias("way"), F.col("p").alias("id"))).when(enough, F.struct(F.lit("dominant").alias("way"), F.col("top.crew_record_id").alias("id")))
    return by.select("disk_id", "source", pick.alias("x")).where("x IS NOT NULL").select("disk_id", "source", F.col("x.id").alias("crew_record_id"), F.col("x.way").alias("way"))
