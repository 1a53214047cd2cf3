"""Result rows and the details of a disc, put together by joins on the ids of a page instead of lookups for each row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diskloom.operators.library import contents_summary
from diskloom.operators.relational import ranked_in
from diskloom.operators.skew import lookup_join
from diskloom.plans.catalogue import Catalogue
from diskloom.plans.find import Page


def result_rows(catalogue: Catalogue, page: Page, local: DataFrame, providers: Iterable[str]) -> DataFrame:
    """The rows of a page in its order with label, crew, year, availability and a summary of the disc's titles.

    ``local``: disk_id of discs in the library. The page's discs are few; every table is joined to them once.
    """
    rows = page.rows.withColumn("place", F.monotonically_increasing_id())  # a page is sorted in one partition
    ids = rows.select("disk_id").distinct()
    discs = catalogue.disks.select(F.col("id").alias("disk_id"), "label", "crew", "year", "platform").join(ids, "disk_id", "left_semi")
    have = local.select("disk_id").distinct().withColumn("_l", F.lit(True))
    hosted = catalogue.locations.where(F.col("provider").isin(list(providers))).select("disk_id").distinct().withColumn("_o", F.lit(True))
    listed = catalogue.contents.join(ids, "disk_id", "left_semi")
    matched = rows.select("disk_id", F.explode("matched").alias("title")).distinct()
    j = rows.join(discs, "disk_id").join(have, "disk_id", "left").join(hosted, "disk_id", "left").join(contents_summary(listed, matched), "disk_id", "left")
    availability = F.when(F.col("_l"), "local").when(F.col("_o"), "online").otherwise("none")
    return j.orderBy("place").select("disk_id", "content_id", "title", "label", "crew", "year", "platform", availability.alias("availability"), F.coalesce("summary", F.lit("")).alias("summary"), "score")


def details(catalogue: Catalogue, disk_id: int) -> dict[str, DataFrame]:
    """Everything about one disc: the disc with its series, its titles in menu order, dumps in rank order and locations by provider. Each is a filtered scan."""
    own = lambda df: df.where(F.col("disk_id") == disk_id)
    disc = catalogue.disks.where(F.col("id") == disk_id).join(catalogue.series.select(F.col("id").alias("series_id"), F.col("name").alias("series_name")), "series_id", "left")
    images = own(catalogue.images)
    order = [c for c in ("rank", "id") if c in images.columns]
    return {"disc": disc, "contents": own(catalogue.contents).orderBy("position", "id"), "images": images.orderBy(*order), "locations": own(catalogue.locations).orderBy("provider")}


def credited_crew(discs: DataFrame, crews: DataFrame) -> DataFrame:
    """``disk_id`` with its crew's record, only where the disc's (corrected) crew still has that record's name."""
    return discs.join(crews.select(F.col("id").alias("crew_id"), F.col("name"), "notes", "members"), "crew_id").where(F.col("name") == F.col("crew")).select("disk_id", "name", "notes", "members")


def enabled_providers(locations: DataFrame, names: dict[str, str], switched_off: Iterable[str]) -> DataFrame:
    """Providers that host something and are not switched off, with their display names: ``provider, name``."""
    shown = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("provider")) if names else F.lit(None).cast("string")
    return locations.select("provider").distinct().where(~F.col("provider").isin(list(switched_off))).select("provider", F.coalesce(shown, "provider").alias("name")).orderBy("provider")


def picture_addresses(media: DataFrame, disks: DataFrame, platforms: Iterable[str] = ()) -> DataFrame:
    """Every picture address once with the first of its sources, in the order of the discs: ``url, source``."""
    rows = media.join(disks.where(F.col("platform").isin(list(platforms))).select(F.col("id").alias("disk_id")), "disk_id", "left_semi") if platforms else media
    by = rows.groupBy("url").agg(F.min("source").alias("source"), F.min("disk_id").alias("_d"), F.min("id").alias("_i"))
    return by.orderBy("_d", "_i").select("url", "source")


def statistics(catalogue: Catalogue, library: DataFrame) -> DataFrame:
    """Counts of the catalogue and the library as ``key, n``."""
    d = catalogue.disks.groupingSets([["platform"], ["kind"], []], "platform", "kind").agg(F.count(F.lit(1)).alias("n"))
    key = F.when(F.col("platform").isNotNull(), F.concat(F.lit("discs on "), "platform")).when(F.col("kind").isNotNull(), F.concat(F.lit("discs of kind "), "kind")).otherwise("discs")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("key"), "n")
    return d.select(key.alias("key"), "n").unionByName(one(catalogue.contents, "titles")).unionByName(one(catalogue.locations.select("disk_id").distinct(), "discs hosted")).unionByName(one(library, "files"))


def titles_in_place(contents: DataFrame) -> DataFrame:
    """Titles of each disc numbered from 1 in menu order."""
    return ranked_in(contents, ["disk_id"], ["position", "id"], "place")


def credit_template(credit: Column, page: Column) -> Column:
    """A credit line as it is stored: its braces doubled, and the page's address in it (without scheme) as "{page}"."""
    bare = F.regexp_replace(page, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    doubled = F.replace(F.replace(credit, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
    return F.when(F.coalesce(bare, F.lit("")) == "", doubled).otherwise(F.replace(doubled, bare, F.lit("{page}")))


def media_credit(template: Column, page: Column) -> Column:
    """A stored credit line with the page's address put in and doubled braces made single; a line with lone braces as it is."""
    bare = F.coalesce(F.regexp_replace(page, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(template, r"\{\{|\}\}", ""), r"\{page\}", "")
    parts = F.split(template, r"\{page\}")
    filled = F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))), "\x1f")
    return F.when(plain.rlike("[{}]"), template).otherwise(F.replace(filled, F.lit("\x1f"), bare))


def media_rows(media: DataFrame, prefixes: DataFrame, credits: DataFrame) -> DataFrame:
    """Pictures with their addresses and credits written out, each address of a disc once, the first by rank, disc before titles, id.

    ``media``: id, disk_id, content_id, kind, rank, and (prefix id, rest) of url, page and thumb; ``prefixes``: id, text;
    ``credits``: id, source, credit. An address is its prefix and its rest; page and thumb may have none.
    """
    part = lambda n: prefixes.select(F.col("id").alias(f"{n}_prefix"), F.col("text").alias(f"_{n}"))
    whole = lambda n: F.coalesce(F.concat(f"_{n}", F.coalesce(f"{n}_rest", F.lit(""))), F.lit(""))
    j = lookup_join(lookup_join(lookup_join(media, part("url"), "url_prefix", "inner"), part("page"), "page_prefix"), part("thumb"), "thumb_prefix")
    j = lookup_join(j, credits.select(F.col("id").alias("credit_id"), "source", "credit"), "credit_id", "inner")
    rows = j.select("id", "disk_id", "content_id", "kind", "rank", whole("url").alias("url"), whole("page").alias("page_url"), whole("thumb").alias("thumb_url"), "source", "credit")
    first = ranked_in(rows, ["disk_id", "url"], ["rank", F.col("content_id").isNotNull(), "id"], "_k").where("_k = 1").drop("_k")
    return first.withColumn("credit", media_credit(F.col("credit"), F.col("page_url")))


def location_rows(locations: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Download locations with their addresses written out: ``locations`` has (prefix id, rest) of url and page."""
    part = lambda n: prefixes.select(F.col("id").alias(f"{n}_prefix"), F.col("text").alias(f"_{n}"))
    whole = lambda n: F.coalesce(F.concat(f"_{n}", F.coalesce(f"{n}_rest", F.lit(""))), F.lit(""))
    j = lookup_join(lookup_join(locations, part("url"), "url_prefix", "inner"), part("page"), "page_prefix")
    gone = ["_url", "_page", *(f"{n}_{x}" for n in ("url", "page") for x in ("prefix", "rest"))]
    return j.withColumn("url", whole("url")).withColumn("page_url", whole("page")).drop(*gone)


def trivia_rows(trivia: DataFrame, contents: DataFrame) -> DataFrame:
    """Facts, notes and articles of discs with their place: what is about the disc first, then about its titles in menu order.

    An article carries its title in ``title`` too.
    """
    rows = lookup_join(trivia, contents.select(F.col("id").alias("content_id"), "position"), "content_id")
    placed = ranked_in(rows, ["disk_id"], [F.col("content_id").isNotNull(), "position", "id"], "place")
    return placed.withColumn("title", F.when(F.col("kind") == "wikipedia", F.col("text")).otherwise("")).drop("position")
