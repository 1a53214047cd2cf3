"""The catalogue snapshot: its tables, their index texts, writing a version and finding the newest valid one."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diskloom.functions import names as N
from diskloom.operators.textindex import build_postings
from diskloom.sources.filesystem import Store

#: Layout of a snapshot; a reader refuses any other.
LAYOUT = 1
#: bm25 weights of the fields of titles and of discs.
ENTRY_WEIGHTS = {"title": 10.0, "disk": 5.0, "crew": 4.0, "people": 2.0, "facets": 2.0, "files": 1.0, "notes": 1.0}
DISK_WEIGHTS = {"label": 10.0, "series": 6.0, "contents": 8.0, "people": 3.0, "notes": 1.0, "crew": 5.0, "facets": 2.0, "files": 1.0}


_TABLES = ("disks", "contents", "images", "locations", "series", "series_alias", "entries", "entry_postings", "disk_postings", "disk_text")


@dataclass(frozen=True)
class Catalogue:
    """A snapshot as DataFrames. ``entries`` has a row for each shown title, or for the disc itself if it lists none."""

    disks: DataFrame
    contents: DataFrame
    images: DataFrame
    locations: DataFrame
    series: DataFrame
    series_alias: DataFrame
    entries: DataFrame
    entry_postings: DataFrame
    disk_postings: DataFrame
    disk_text: DataFrame


def disc_order() -> list:
    """The order that numbers discs: series before others, then label, number, part and version as people count them."""
    return [
        F.col("platform"), F.when(F.col("series_id") != "", 0).otherwise(1), N.sort_key(F.coalesce("series_name", F.lit(""))), F.col("number").asc_nulls_last(),
        F.col("part"), F.col("version"), N.sort_key(F.col("label")), F.col("label"), F.col("sequence"),
    ]


def number_discs(disks: DataFrame) -> DataFrame:
    """``disks`` (with ``series_name`` and ``sequence``, the order of the merge) with ids 1, 2, ... in disc order.

    The ids must be dense over all discs, so this is the one global order of a build. Rows are range-partitioned and
    sorted; each partition's count gives the offset of the next, so no single task holds all rows.
    """
    keyed = disks.select("*", *(k.alias(f"_k{i}") if i != 3 else F.struct(F.col("number").isNull(), F.col("number")).alias("_k3") for i, k in enumerate(disc_order())))
    keys = [f"_k{i}" for i in range(9)]
    parts = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id())
    parts = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*keys)))
    from diskloom.session import cut

    parts = cut(parts)
    before, offsets = 0, []
    for p, n in sorted(tuple(r) for r in parts.groupBy("_p").count().collect()):  # one row for each partition
        offsets.append((p, before))
        before += n
    starts = disks.sparkSession.createDataFrame(offsets or [(0, 0)], "_p int, _before long")
    return parts.join(F.broadcast(starts), "_p").withColumn("id", F.col("_before") + F.col("_n")).drop("_p", "_n", "_before", *keys)


def entries_of(disks: DataFrame, contents: DataFrame) -> DataFrame:
    """The rows that a search by titles shows: ``id, disk_id, content_id, title, sort_title, kind``, ids in disc and menu order.

    A disc that lists no title is its own row under its label. Ids are (disc, place), packed, so they need no global
    order: they ascend with the disc and then with the place on it.
    """
    place = F.row_number().over(Window.partitionBy("disk_id").orderBy("position", "id"))
    shown = contents.select((F.col("disk_id") * F.lit(1 << 20) + place).alias("id"), "disk_id", F.col("id").alias("content_id"), N.display_title(F.col("title")).alias("title"), "kind")
    bare = disks.join(contents.select(F.col("disk_id").alias("id")).distinct(), "id", "left_anti")
    own = bare.select((F.col("id") * F.lit(1 << 20)).alias("id"), F.col("id").alias("disk_id"), F.lit(None).cast("long").alias("content_id"), F.col("label").alias("title"), F.col("kind"))
    rows = shown.unionByName(own)
    return rows.select("id", "disk_id", "content_id", "title", N.sort_title(F.col("title")).alias("sort_title"), "kind")


def _joined(*columns):
    return F.trim(F.concat_ws(" ", *columns))


def _disc_texts(disks: DataFrame, series: DataFrame, images: DataFrame) -> DataFrame:
    """Search words of each disc that its titles share: names, crew, people, facets, file names and notes."""
    files = images.groupBy("disk_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    rows = disks.join(series.select(F.col("id").alias("series_id"), F.col("name").alias("series_name")), "series_id", "left").join(files, disks["id"] == files["disk_id"], "left")
    date = F.concat_ws(" ", F.col("year").cast("string"), F.lpad(F.col("month").cast("string"), 2, "0"))
    return rows.select(
        disks["id"].alias("disk_id"), "label",
        N.title_search_text(_joined("label", F.coalesce("title", F.lit("")))).alias("disk"),
        N.title_search_text(F.coalesce("series_name", F.lit(""))).alias("series"),
        N.search_text(F.col("crew")).alias("crew"),
        N.search_text(_joined("publisher", "cracker")).alias("people"),
        N.distinct_words(_joined(N.search_text(_joined("platform", "kind", "category")), date)).alias("facets"),
        N.file_name_words(F.coalesce("names", F.array().cast("array<string>"))).alias("files"),
        N.distinct_words(N.search_text(F.coalesce("notes", F.lit("")))).alias("notes"),
    )


def entry_texts(entries: DataFrame, contents: DataFrame, disc_texts: DataFrame) -> DataFrame:
    """Index fields of each entry: its title with other names, and what its disc says."""
    extra = contents.select(F.col("id").alias("content_id"), N.akas(F.coalesce("extra", F.lit(""))).alias("other"), F.coalesce("extra", F.lit("")).alias("extra"), F.coalesce("publisher", F.lit("")).alias("p"), F.coalesce("cracker", F.lit("")).alias("c"))
    rows = entries.join(extra, "content_id", "left").join(disc_texts, "disk_id")
    return rows.select(
        "id",
        N.title_search_text(_joined("title", F.array_join(F.coalesce("other", F.array().cast("array<string>")), " "))).alias("title"),
        _joined("disk", "series").alias("disk"), "crew", N.distinct_words(_joined("people", N.search_text(_joined("p", "c")))).alias("people"),
        N.distinct_words(_joined("facets", N.search_text(F.col("kind")))).alias("facets"), "files", N.distinct_words(_joined("notes", N.search_text(F.coalesce("extra", F.lit(""))))).alias("notes"),
    )


def disk_texts(disc_texts: DataFrame, contents: DataFrame) -> DataFrame:
    """Index fields of each disc, and ``text``, in which words are looked for inside."""
    titles = contents.groupBy("disk_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", "title"))).alias("t"))
    rows = disc_texts.join(titles, "disk_id", "left")
    listed = F.array_join(F.transform(F.coalesce("t", F.array().cast("array<struct<position:int,id:bigint,title:string>>")), lambda x: x["title"]), " ")
    return rows.select(F.col("disk_id").alias("id"), F.col("disk").alias("label"), "series", N.title_search_text(listed).alias("contents"), "people", "notes", "crew", "facets", "files", N.normalise(_joined("label", listed)).alias("text"))


def build_catalogue(disks: DataFrame, contents: DataFrame, images: DataFrame, locations: DataFrame, series: DataFrame, series_alias: DataFrame) -> Catalogue:
    """A catalogue with entries and postings from its plain tables."""
    entries = entries_of(disks, contents)
    shared = _disc_texts(disks, series, images)
    by_disc = disk_texts(shared, contents)
    return Catalogue(
        disks, contents, images, locations, series, series_alias, entries,
        build_postings(entry_texts(entries, contents, shared), "id", list(ENTRY_WEIGHTS)), build_postings(by_disc, "id", list(DISK_WEIGHTS)), by_disc.select("id", "text"),
    )


_TABLES = list(Catalogue.__dataclass_fields__)


def write_snapshot(catalogue: Catalogue, folder: str, meta: dict[str, str]) -> str:
    """Write a new version under ``folder`` and make it the current one; returns its path.

    ``folder`` may be on any file system that Spark reaches. Tables go to a folder of their own that is renamed when
    all are complete, then the pointer file is replaced, so a reader sees the old version or the new one, never a part.
    Postings are sorted by token, so that word predicates skip row groups.
    """
    store = Store(folder, catalogue.disks.sparkSession)
    path = f"{folder.rstrip('/')}/version-{uuid.uuid4().hex}"
    for name in _TABLES:
        df: DataFrame = getattr(catalogue, name)
        if name.endswith("postings"):
            df = df.repartitionByRange("token").sortWithinPartitions("token", "id")
        df.write.mode("error").parquet(f"{path}.part/{name}")
    store.write_text(f"{path}.part/meta.json", json.dumps({"layout": LAYOUT, **meta}))
    store.rename(f"{path}.part", path)
    set_current(store, folder, path)
    return path


def set_current(store: Store, folder: str, path: str) -> None:
    """Make a version the current one of its folder: the pointer file is written beside and renamed."""
    folder = folder.rstrip("/")
    store.write_text(f"{folder}/current.part", path.rsplit("/", 1)[-1])
    store.rename(f"{folder}/current.part", f"{folder}/current")


def _meta(path: str) -> dict:
    store = Store(path)
    return json.loads(store.read_text(f"{path}/meta.json")) if store.exists(f"{path}/meta.json") else {}


def layout_problem(path: str) -> str:
    """Why a snapshot cannot be read, '' if it can."""
    try:
        layout = _meta(path).get("layout")
    except ValueError:
        layout = None
    if layout is None:
        return "it has no readable description"
    if layout != LAYOUT:
        return f"its layout is {layout}, this reader's is {LAYOUT}"
    store = Store(path)
    missing = [t for t in _TABLES if not store.is_folder(f"{path}/{t}")]
    return f"it lacks {', '.join(missing)}" if missing else ""


def locate_snapshot(candidates: list[str]) -> str | None:
    """The valid candidate that was built last (by its ``built_at`` text); of equals the first."""
    best, newest = None, ""
    for path in candidates:
        if not layout_problem(path):
            built = _meta(path).get("built_at", "")
            if best is None or built > newest:
                best, newest = path, built
    return best


def open_snapshot(spark: SparkSession, path: str) -> Catalogue:
    """The tables of a snapshot, or of the current version of a folder of versions."""
    store, path = Store(path, spark), path.rstrip("/")
    if store.exists(f"{path}/current"):
        path = f"{path}/{store.read_text(f'{path}/current').strip()}"
    if problem := layout_problem(path):
        raise ValueError(f"snapshot {path} cannot be read: {problem}")
    return Catalogue(**{name: spark.read.parquet(f"{path}/{name}") for name in _TABLES})
