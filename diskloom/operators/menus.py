"""Disc records from the tables of two source databases: one of menu discs, one of scene productions.

Each is a set of dump tables that refer to one another by id; the record is a row of joined tables with its lists
gathered, so a build reads every table once and joins it once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diskloom.functions import names as N
from diskloom.operators.importing import positional_parts
from diskloom.operators.relational import first_n_distinct, present, ranked_in
from diskloom.operators.skew import lookup_join

# Picture files that are shown.
PICTURE_TYPES = ("png", "jpg", "jpeg", "gif", "webp")


def menu_label(number: Column, issue: Column, version: Column) -> Column:
    """The number of a menu as its set writes it: number or issue, and a version behind it."""
    base = F.coalesce(number.cast("string"), present(F.trim(issue)), F.lit(""))
    return F.trim(F.concat_ws(" ", present(base), F.when(F.coalesce(F.trim(version), F.lit("")) != "", F.concat(F.lit("v"), F.regexp_replace(F.trim(version), "(?i)^v", "")))))


def menu_discs(sets: DataFrame, menus: DataFrame, discs: DataFrame, conditions: DataFrame, people: DataFrame, crews: DataFrame, contents: DataFrame, dumps: DataFrame) -> DataFrame:
    """A record for each disc of each menu: ``disk_id, set_id, number, part, version, title, damaged, notes, crews, contents, images``.

    ``sets``: id, name; ``menus``: id, set_id, number, issue, version; ``discs``: id, menu_id, part, condition_id,
    donor_id, notes; ``conditions``: id, name; ``people``: id, name; ``crews``: set_id, name, position; ``contents``:
    disk_id, id, position, title, kind, other (another name, or ''); ``dumps``: disk_id, id, name, sha512, size. Parts
    are given by place within the menu. Discs of missing menus or sets are left out; a missing condition, donor or list
    is none.
    """
    one = lambda df, key, name: df.select(F.col("id").alias(key), F.col("name").alias(name))
    j = lookup_join(discs, menus.select(F.col("id").alias("menu_id"), "set_id", "number", "issue", "version"), "menu_id", "inner")
    j = lookup_join(j, one(sets, "set_id", "set_name"), "set_id", "inner")
    j = lookup_join(lookup_join(j, one(conditions, "condition_id", "condition"), "condition_id"), one(people, "donor_id", "donor"), "donor_id")
    j = positional_parts(j.withColumnRenamed("id", "disk_id"), ["menu_id"], "part", ["disk_id"])
    listed = lambda df, key, order, value, name: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, *value))), lambda x: F.struct(*(x[v].alias(v) for v in value))).alias(name))
    by_set = crews.groupBy("set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]).alias("crews"))
    titles = listed(contents, "disk_id", ("position", "id"), ("title", "kind", "other"), "contents")
    images = listed(dumps, "disk_id", ("id",), ("name", "sha512", "size"), "images")
    j = j.join(by_set, "set_id", "left").join(titles, "disk_id", "left").join(images, "disk_id", "left")
    raw = F.trim(F.coalesce("part", F.lit("")))
    shown = F.concat_ws(" ", "set_name", present(menu_label(F.col("number"), F.col("issue"), F.col("version"))))
    title = F.when(raw == "", shown).when(raw.rlike("^[_.]"), F.concat(shown, raw)).otherwise(F.concat(shown, F.lit(" "), raw))
    others = F.transform(F.filter(F.coalesce("contents", F.array().cast(titles.schema["contents"].dataType)), lambda c: F.coalesce(c["other"], F.lit("")) != ""), lambda c: F.concat(c["title"], F.lit(" is also known as "), c["other"], F.lit(".")))
    notes = F.concat_ws("\n", present(F.trim(F.coalesce("notes", F.lit("")))), F.when(F.coalesce("donor", F.lit("")) != "", F.concat(F.lit("Donated by "), "donor", F.lit("."))), present(F.array_join(others, "\n")))
    damaged = F.lower(F.coalesce("condition", F.lit(""))).rlike("damaged|missing|incomplete")
    return j.select("disk_id", "set_id", "number", F.col("final_part").alias("part"), N.normalise_version(F.coalesce("version", F.lit(""))).alias("version"), F.when(F.col("number").isNull(), title).otherwise("").alias("title"), damaged.alias("damaged"), notes.alias("notes"), "crews", "contents", "images")


def shown_pictures(rows: DataFrame, owner: str, *, most: int, types: Sequence[str] = PICTURE_TYPES) -> DataFrame:
    """The first ``most`` pictures (``owner``, id, extension) of each owner, of file types that are shown: ``owner, place, id, extension``."""
    kind = F.lower(F.trim(F.coalesce("extension", F.lit(""))))
    kept = rows.select(owner, "id", kind.alias("extension")).where(F.col("extension").isin(*types)).distinct()
    return ranked_in(kept, [owner], ["id"], "place").where(F.col("place") <= most)


def production_index(productions: DataFrame, platforms: DataFrame, types: DataFrame, authors: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """``production_id, platform, platforms, kind, groups`` of each production on a wanted platform.

    ``platforms``: production_id, ord, platform, the first wanted one counts; ``types``: production_id, path, whose first
    four signs name the kind; ``authors``: production_id, ord, name, is_group. Productions on no wanted platform are out.
    """
    on = platforms.groupBy("production_id").agg(F.min(F.when(F.col("platform").isin(*wanted), F.struct("ord", "platform")))["platform"].alias("platform"), F.array_sort(F.collect_set("platform")).alias("platforms")).where("platform IS NOT NULL")
    kind = types.groupBy("production_id").agg(F.min(F.substring("path", 1, 4)).alias("kind"))
    by = authors.where("is_group").groupBy("production_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("ord", "name"))), lambda x: x["name"]).alias("groups"))
    known = productions.select(F.col("id").alias("production_id"), "title").join(on, "production_id")
    return known.join(kind, "production_id", "left").join(by, "production_id", "left").select("production_id", "title", "platform", "platforms", "kind", F.coalesce("groups", F.array().cast("array<string>")).alias("groups"))


def menu_intros(index: DataFrame, kinds: Sequence[str], listed: DataFrame) -> DataFrame:
    """Productions that are intros of numbered menus: ``production_id, series_id, number``.

    The title must end in a number, and what stands before it must be a series (``listed``: key, platform, series_id) by
    its comparison form, alone or behind the name of one of the production's groups.
    """
    pattern = r"^(.*?)[\s#]*(\d{1,4})\s*$"
    rows = index.where(F.col("kind").isin(*kinds)).select("production_id", "platform", "groups", F.regexp_extract("title", pattern, 1).alias("head"), F.regexp_extract("title", pattern, 2).alias("n")).where("n <> ''")
    heads = F.concat(F.array(F.struct(F.lit(0).alias("way"), F.col("head").alias("text"))), F.transform("groups", lambda g: F.struct(F.lit(1).alias("way"), F.concat(g, F.lit(" "), F.col("head")).alias("text"))))
    keyed = rows.select("production_id", "platform", F.col("n").cast("int").alias("number"), F.explode(heads).alias("h")).withColumn("key", N.ascii_words(F.col("h.text")))
    best = keyed.join(listed.groupBy("key", "platform").agg(F.min("series_id").alias("series_id")), ["key", "platform"]).groupBy("production_id", "number").agg(F.min(F.struct("h.way", "series_id"))["series_id"].alias("series_id"))
    return best.select("production_id", "series_id", "number")


def scene_discs(index: DataFrame, members: DataFrame, screenshots: DataFrame, links: DataFrame, games: Sequence[str], menus: Sequence[str]) -> DataFrame:
    """A record for each pack or menu among the productions: ``production_id, platform, title, groups, contents, pictures, urls``.

    ``members``: production_id, position, member_id; ``screenshots``: production_id, id, url; ``links``: production_id,
    url (of ``importing.download_links``). A member of a game's intro kind (``games``) stands for that game on a menu, on
    other discs for an intro; a member that is not on the disc's platform is out. One picture is shown for each
    different title of the members, in their order, the disc's own before them.
    """
    own = index.select("production_id", "platform", "title", "groups", F.col("kind").isin(*menus).alias("is_menu"))
    inside = members.join(own.select("production_id", "platform", "is_menu"), "production_id").join(index.select(F.col("production_id").alias("member_id"), F.col("title").alias("member"), F.col("kind").alias("member_kind"), F.col("platforms").alias("_on")), "member_id")
    inside = inside.where(F.array_contains("_on", F.col("platform")))
    kind = F.when(F.col("member_kind").isin(*games), F.when(F.col("is_menu"), "game").otherwise("intro")).otherwise("demo")
    contents = inside.withColumn("k", kind).groupBy("production_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "member_id", F.col("member").alias("title"), F.col("k").alias("kind")))), lambda x: F.struct(x["title"].alias("title"), x["kind"].alias("kind"))).alias("contents"))
    first = screenshots.groupBy("production_id").agg(F.min(F.struct("id", "url"))["url"].alias("url"))
    shown = inside.select("production_id", "position", "member_id", F.lower("member").alias("title")).join(first.withColumnRenamed("production_id", "member_id"), "member_id")
    shown = shown.groupBy("production_id", "title").agg(F.min(F.struct("position", "url")).alias("at")).unionByName(own.select("production_id").join(first, "production_id").select("production_id", F.lit("").alias("title"), F.struct(F.lit(-1).alias("position"), "url").alias("at")))
    pictures = shown.groupBy("production_id").agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["url"]).alias("pictures"))
    urls = first_n_distinct(links, ["production_id"], "url", ["url"], 1 << 20).groupBy("production_id").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    discs = own.join(contents, "production_id", "left").join(pictures, "production_id", "left").join(urls, "production_id", "left")
    return discs.where("contents IS NOT NULL OR urls IS NOT NULL").drop("is_menu")
