"""A library of files kept in step with folders and with catalogue snapshots: scans, matches, links, corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.functions import names as N
from diskloom.functions.dumpnames import dump_name, tidy_label
from diskloom.functions.images import inspect_image
from diskloom.session import cut
from diskloom.operators.relational import latest_rows, match_in_order, present, ranked_in, upsert
from diskloom.sources.files import expand_archives, with_hashes


def plan_scan(known: DataFrame, found: DataFrame, unreadable: Sequence[str] = (), cancelled: bool = False) -> DataFrame:
    """What a scan has to do with each path: ``path, action`` of read, skip, remove or keep.

    ``known``: path, size, mtime, error; ``found``: path, size, mtime. A file of the same size and time that gave no
    error is skipped. A file that is gone is removed only if its folder could be read and the scan was not cancelled.
    """
    k = known.select("path", F.struct("size", "mtime").alias("k"), F.coalesce("error", F.lit("")).alias("e"))
    both = k.join(found.select("path", F.struct("size", "mtime").alias("f")), "path", "full")
    hidden = F.lit(cancelled)
    for folder in unreadable:
        hidden = hidden | F.col("path").startswith(folder.rstrip("/") + "/")
    gone = F.when(hidden, "keep").otherwise("remove")
    action = F.when(F.col("f").isNull(), gone).when(F.col("k").eqNullSafe(F.col("f")) & (F.col("e") == ""), "skip").otherwise("read")
    return both.select("path", action.alias("action"))


def index_files(files: DataFrame) -> DataFrame:
    """An entry for each image in files (``path, content``), archives expanded: hashes of the file and of its sectors, format, label, error."""
    rows = with_hashes(expand_archives(files).where("content IS NOT NULL OR error <> ''"))
    name = F.when(F.col("member") != "", F.col("member")).otherwise(F.col("path"))
    rows = rows.withColumn("i", inspect_image(F.col("content"), name))
    base = N.base_name(name)
    shown = F.when(F.size(dump_name(base)["flags"]) + F.size(dump_name(base)["extra"]) > 0, tidy_label(base)).otherwise(F.regexp_replace(base, r"\.[^.]*$", ""))
    return rows.select(
        "path", "member", "size_bytes", "crc32", "md5", "sha1", "sha512", F.col("i.format").alias("format"), F.col("i.platform").alias("platform"), F.col("i.raw_size").alias("raw_size"), F.col("i.raw_md5").alias("raw_md5"),
        F.col("i.raw_sha1").alias("raw_sha1"), F.col("i.raw_crc32").alias("raw_crc32"), F.col("i.label").alias("label"), shown.alias("display_name"), F.coalesce(present(F.col("error")), F.col("i.problem")).alias("error"),
    )


def store_scan(entries: DataFrame, plan: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entries after a scan: those of removed and of read files go, those just read come."""
    return entries.join(plan.where(F.col("action").isin("remove", "read")).select("path"), "path", "left_anti").unionByName(fresh, allowMissingColumns=True)


def match_entries(entries: DataFrame, images: DataFrame, entry_id: str = "id") -> DataFrame:
    """The dump that each entry is a copy of: ``id, image_id, attempt``.

    Sectors are compared where an image was decoded, else the file: md5, sha1, CRC with size; then the file's sha512 and
    md5. Good dumps come first.
    """
    decoded = (F.coalesce("raw_md5", F.lit("")) != "") | (F.coalesce("raw_sha1", F.lit("")) != "") | (F.coalesce("raw_crc32", F.lit("")) != "")
    pick = lambda raw, own: F.when(decoded, F.col(raw)).otherwise(F.col(own))
    probes = entries.select(entry_id, pick("raw_md5", "md5").alias("p_md5"), pick("raw_sha1", "sha1").alias("p_sha1"), pick("raw_crc32", "crc32").alias("p_crc"), F.when(decoded, F.coalesce("raw_size", "size_bytes")).otherwise(F.col("size_bytes")).alias("p_size"), "sha512", F.col("md5").alias("f_md5"))
    attempts = [({"p_md5": "md5"}, "md5"), ({"p_sha1": "sha1"}, "sha1"), ({"p_crc": "crc32", "p_size": "size"}, "crc32"), ({"sha512": "sha512"}, "file sha512"), ({"f_md5": "md5"}, "file md5")]
    return match_in_order(probes, entry_id, images, attempts, ["bad", "rank"], "image_id")


def with_kept_links(matched: DataFrame, kept: DataFrame) -> DataFrame:
    """Entries (``path, member, sha1, raw_sha1, disk_id``) with the disc that the user linked a file to, where no dump matched.

    ``kept``: path, member, sha1, kept_disk. A link holds as long as the sectors (or the file) still have its sha1.
    """
    j = matched.join(kept.select("path", "member", F.lower("sha1").alias("_s"), "kept_disk"), ["path", "member"], "left")
    own = F.lower(F.coalesce(present(F.col("raw_sha1")), F.col("sha1")))
    return j.withColumn("disk_id", F.coalesce("disk_id", F.when(own == F.col("_s"), F.col("kept_disk")))).drop("_s", "kept_disk")


def identities(disks: DataFrame, images: DataFrame) -> DataFrame:
    """What names each disc beyond one snapshot: ``disk_id, platform, series_id, number, part, version, hashes`` (in order of rank)."""
    hashes = images.groupBy("disk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "image_id", "md5", "sha1", "sha512", "crc32", "size"))), lambda x: F.struct(x["md5"].alias("md5"), x["sha1"].alias("sha1"), x["sha512"].alias("sha512"), x["crc32"].alias("crc32"), x["size"].alias("size"))).alias("hashes"))
    return disks.select(F.col("id").alias("disk_id"), "platform", "series_id", "number", "part", "version").join(hashes, "disk_id", "left")


def find_discs(wanted: DataFrame, disks: DataFrame, images: DataFrame) -> DataFrame:
    """The disc of a new snapshot for each identity (``key`` and the columns of ``identities``): ``key, disk_id``, NULL if it is gone.

    A numbered disc is found by its number, any other, and one that is numbered otherwise now, by the first of its
    dumps that a disc of its platform has.
    """
    named = disks.where("series_id <> ''").groupBy("series_id", F.coalesce("number", F.lit(-1)).alias("number"), "part", "version").agg(F.min("id").alias("by_number"))
    rows = wanted.withColumn("_n", F.coalesce("number", F.lit(-1)))
    j = rows.join(named.withColumnRenamed("number", "_n"), ["series_id", "_n", "part", "version"], "left")
    dumps = j.where("by_number IS NULL").select("key", "platform", F.posexplode(F.coalesce("hashes", F.array().cast(wanted.schema["hashes"].dataType))).alias("at", "h")).select(F.concat_ws("\x1f", F.col("key").cast("string"), F.col("at").cast("string")).alias("probe"), "key", "platform", "at", "h.*")
    hits = match_in_order(dumps, "probe", images, [({"md5": "md5"}, "md5"), ({"sha1": "sha1"}, "sha1"), ({"sha512": "sha512"}, "sha512"), ({"crc32": "crc32", "size": "size"}, "crc32")], ["bad", "rank"], "image_id")
    owned = hits.join(images.select("image_id", "disk_id"), "image_id").join(disks.select(F.col("id").alias("disk_id"), F.col("platform").alias("_pl")), "disk_id")
    by_dump = owned.join(dumps.select("probe", "key", "platform", "at"), "probe").where(F.col("_pl") == F.col("platform")).groupBy("key").agg(F.min(F.struct("at", "disk_id"))["disk_id"].alias("by_dump"))
    return j.select("key", "by_number").join(by_dump, "key", "left").select("key", F.coalesce("by_number", "by_dump").alias("disk_id"))


# Corrections: one row (disk_id, field, value) for each corrected field, (disk_id, title, occurrence, value) for each title

#: Fields of a disc that a user may correct, and those that cannot be empty.
EDITABLE, REQUIRED = ("label", "title", "date", "publisher", "cracker", "crew", "notes"), ("label",)


def corrections_from_form(disks: DataFrame, form: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The corrections in a form (``disk_id, field, value``) that differ from the catalogue, and the rows that cannot be taken with the reason.

    Blanks are tidied but in notes; a date must exist in the calendar; required fields need a value.
    """
    fields = [f for f in EDITABLE if f != "date"]
    now = disks.select(F.col("id").alias("disk_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("old")) for f in fields), F.struct(F.lit("date").alias("field"), N.date_text(F.struct("year", "month", "day")).alias("old")))).alias("x")).select("disk_id", "x.*")
    tidy = F.when(F.col("field") == "notes", F.col("value")).otherwise(F.trim(F.regexp_replace("value", r"\s+", " ")))
    rows = form.where(F.col("field").isin(*EDITABLE)).withColumn("value", tidy).join(now, ["disk_id", "field"])
    dated = F.col("field") == "date"
    wrong = F.when(F.col("field").isin(*REQUIRED) & (F.col("value") == ""), "a value is needed").when(dated & (F.col("value") != "") & N.strict_date(F.col("value")).isNull(), "not a date")
    rows = rows.withColumn("problem", wrong)
    value = F.when(dated & (F.col("value") != ""), N.date_text(N.strict_date(F.col("value")))).otherwise(F.col("value"))
    good = rows.where("problem IS NULL").withColumn("value", value).where(F.trim("value") != F.trim("old"))
    return good.select("disk_id", "field", "value"), rows.where("problem IS NOT NULL").select("disk_id", "field", "problem")


def store_corrections(old: DataFrame, disk_ids: DataFrame, new: DataFrame) -> DataFrame:
    """All corrections with those of the given discs replaced by ``new``; none for a disc takes its corrections back."""
    return old.join(disk_ids.select("disk_id").distinct(), "disk_id", "left_anti").unionByName(new)


def correction_maps(corrections: DataFrame) -> DataFrame:
    """``disk_id, fields`` (a map) of each corrected disc; of repeated rows the largest value counts."""
    once = corrections.groupBy("disk_id", "field").agg(F.max("value").alias("value"))
    return once.groupBy("disk_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def corrected_discs(disks: DataFrame, corrections: DataFrame) -> DataFrame:
    """``disks`` with corrected values in place of the catalogue's; a stored date that is none any more is passed over."""
    j = disks.join(correction_maps(corrections).withColumnRenamed("disk_id", "id"), "id", "left")
    date = N.strict_date(F.col("fields")["date"])
    parts = {p: F.when(date.isNotNull(), date[p]).when(F.col("fields")["date"] == "", None).otherwise(F.col(p)) for p in ("year", "month", "day")}
    out = {f: F.coalesce(F.col("fields")[f], F.col(f)) for f in EDITABLE if f != "date" and f in disks.columns}
    return j.withColumns(out | {p: c for p, c in parts.items() if p in disks.columns}).drop("fields")


def corrected_titles(contents: DataFrame, renamed: DataFrame) -> DataFrame:
    """``contents`` with renamed titles; a title is told by its name and which one of that name on its disc it is."""
    rows = ranked_in(contents, ["disk_id", "title"], ["position", "id"], "occurrence")
    j = rows.join(renamed.select("disk_id", "title", "occurrence", F.col("value").alias("_v")), ["disk_id", "title", "occurrence"], "left")
    return j.withColumn("title", F.coalesce("_v", "title")).select(*contents.columns)


# Choosing what to use


def best_copies(files: DataFrame, images: DataFrame) -> DataFrame:
    """The file to use for each disc: of a good dump before others, by dump rank, a plain file before an archive, then by path."""
    j = files.join(images.select("image_id", "bad", F.col("rank").alias("_rank")), "image_id", "left")
    order: list[Column] = [F.coalesce("bad", F.lit(True)), F.col("_rank").asc_nulls_last(), F.col("member") != "", F.length("path"), F.col("path"), F.col("member")]
    return latest_rows(j.where("disk_id IS NOT NULL"), ["disk_id"], order).drop("_rank", "bad")


def verify_downloads(downloads: DataFrame, expected: DataFrame) -> DataFrame:
    """``download_id, verdict``: the first hash kind that a download does not have as expected, '' if all fit, "unchecked" if none is known.

    ``expected``: download_id, kind, value; kinds are columns of ``downloads``. Kinds without a column cannot be checked.
    """
    kinds = [k for k in ("md5", "sha1", "sha512", "crc32") if k in downloads.columns]
    own = downloads.select("download_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lower(k).alias("own")) for k in kinds))).alias("x")).select("download_id", "x.*")
    checks = expected.where("value <> ''").withColumn("kind", F.lower("kind")).join(own, ["download_id", "kind"])
    result = checks.groupBy("download_id").agg(F.min(F.when(F.lower("value") != F.col("own"), F.col("kind"))).alias("bad"))
    return downloads.select("download_id").join(result.withColumn("known", F.lit(True)), "download_id", "left").select("download_id", F.when(F.col("known").isNull(), "unchecked").otherwise(F.coalesce("bad", F.lit(""))).alias("verdict"))


def summary_articles(disk: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles for each disc: its title's, then its own, then its crew's, each title once whatever its case: ``disk_id, place, title, url``."""
    rank = F.when(F.col("about") == "title", 0).when(F.col("about") == "disc", 1).otherwise(2)
    rows = disk.select("disk_id").join(articles, "disk_id").withColumn("_r", rank)
    once = rows.groupBy("disk_id", F.lower("title").alias("_l")).agg(F.min(F.struct("_r", "title", "url")).alias("a"))
    return ranked_in(once, ["disk_id"], ["a._r", "a.title", "a.url"], "place").select("disk_id", "place", "a.title", "a.url")


def contents_summary(contents: DataFrame, matched: DataFrame, n: int = 6) -> DataFrame:
    """``disk_id, summary``: up to ``n`` different titles, matched ones kept first but shown in menu order, and how many more there are."""
    once = contents.groupBy("disk_id", F.lower("title").alias("_l")).agg(F.min(F.struct("position", "id", "title")).alias("t"))
    marked = once.join(matched.select("disk_id", F.lower("title").alias("_l"), F.lit(True).alias("hit")).distinct(), ["disk_id", "_l"], "left")
    kept = ranked_in(marked, ["disk_id"], [F.col("hit").isNull(), "t.position", "t.id"], "_k")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") <= n, F.col("t")))), lambda x: x["title"]), ", ")
    more = F.greatest(F.count(F.lit(1)) - n, F.lit(0))
    out = kept.groupBy("disk_id").agg(listed.alias("s"), more.alias("m"))
    return out.select("disk_id", F.when(F.col("m") > 0, F.concat("s", F.lit(" and "), F.col("m").cast("string"), F.lit(" more"))).otherwise(F.col("s")).alias("summary"))


# History


def record_session(sessions: DataFrame, items: DataFrame, session: DataFrame, session_items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A session's header (``id, started, finished``) and its items (``session_id, at, name, status``) added to the history; storing one again replaces it."""
    kept = items.join(session.select(F.col("id").alias("session_id")), "session_id", "left_anti")
    return upsert(sessions, session, ["id"]), kept.unionByName(session_items)


def recent_sessions(sessions: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The ``n`` last sessions with the count of each status and the items in order, in one join."""
    top = sessions.orderBy(F.col("started").desc(), F.col("id").desc()).limit(n)
    by = items.groupBy("session_id").agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.transform(F.array_sort(F.collect_list(F.struct("at", "name", "status"))), lambda x: F.concat(x["name"], F.lit(": "), x["status"])).alias("lines"))
    return top.join(by, top["id"] == by["session_id"], "left").drop("session_id").orderBy(F.col("started").desc(), F.col("id").desc())


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows."""
    return spark.createDataFrame([], schema)


def search_unmatched(entries: DataFrame, text: str, limit: int = 200) -> DataFrame:
    """Entries (id, disk_id, display_name, label, listing, path, member) without a disc whose names hold every word of a text, best first.

    Words match the beginnings of words of name, label and file listing, ranked by bm25; without a word all such
    entries come in order of their names.
    """
    from diskloom.operators import textindex as X
    from diskloom.plans.find import plain_words

    rows = entries.where("disk_id IS NULL")
    expression = X.word_query(plain_words(text))
    if expression is None:
        return rows.orderBy("display_name", "path", "member").limit(limit)
    fields = ["display_name", "label", "listing"]
    texts = entries.select("id", *(N.search_text(F.coalesce(c, F.lit(""))).alias(c) for c in fields))  # rarity counts all entries, as the index holds all
    found = X.ranked(X.text_index(texts, "id", dict.fromkeys(fields, 1.0), cut(X.build_postings(texts, "id", fields))), expression)
    return rows.join(found, "id").orderBy("rank", "display_name", "id").limit(limit)


def library_counts(entries: DataFrame) -> DataFrame:
    """Images, matched and unmatched ones, copies of the same data and folders of a library, in one row."""
    data = F.when(F.coalesce("raw_md5", F.lit("")) != "", F.col("raw_md5")).otherwise(F.col("md5"))
    n, matched = F.count(F.lit(1)), F.count("disk_id")
    return entries.agg(n.alias("images"), matched.alias("matched"), (n - matched).alias("unmatched"), (F.count(data) - F.countDistinct(data)).alias("copies"), F.countDistinct(F.regexp_extract("path", "^(.*)/[^/]*$", 1)).alias("folders"))


def scanned_files(entries: DataFrame) -> DataFrame:
    """What a scan knows of each file: ``path, size, mtime, error``, an error of any of its images counts."""
    return entries.groupBy("path").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime"), F.coalesce(F.max(present(F.col("error"))), F.lit("")).alias("error"))


def infected_entries(entries: DataFrame, limit: int = 200) -> DataFrame:
    """Images whose boot block holds a virus, in order of their names; their number is the ``count`` of the unlimited ones."""
    return entries.where("boot_status = 'virus'").orderBy("display_name", "path", "member").limit(limit)


def checked_blocks(entries: DataFrame) -> DataFrame:
    """Images whose boot block was checked, to be checked again when the reference data changes."""
    return entries.where("coalesce(boot_status, '') <> ''")


def recheck_blocks(entries: DataFrame, statuses: DataFrame, fingerprint: str, known: str) -> DataFrame:
    """``id, boot_status, boot_name`` of entries whose status is other under the reference data of ``fingerprint``; none if that was ``known``.

    ``statuses``: id, status, name, as ``boot.classify`` gives them for the blocks that could be read.
    """
    if fingerprint == known:
        return statuses.where("false").select("id", F.col("status").alias("boot_status"), F.col("name").alias("boot_name"))
    j = checked_blocks(entries).select("id", "boot_status", "boot_name").join(statuses, "id")
    other = ~(F.col("boot_status").eqNullSafe(F.col("status")) & F.coalesce("boot_name", F.lit("")).eqNullSafe(F.coalesce("name", F.lit(""))))
    return j.where(other).select("id", F.col("status").alias("boot_status"), F.col("name").alias("boot_name"))


def link_files(kept: DataFrame, entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """``kept`` (path, member, sha1, kept_disk, source) with files linked to discs (``wanted``: path, disk_id, source).

    Only a file with a single image that matches no dump can be linked: a match wins over a link. Linking again
    replaces the link.
    """
    own = F.lower(F.coalesce(present(F.col("raw_sha1")), F.col("sha1")))
    single = entries.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count("image_id").alias("m"), F.min("member").alias("member"), F.min(own).alias("sha1")).where("n = 1 AND m = 0 AND sha1 <> ''")
    fresh = wanted.join(single, "path").select("path", "member", "sha1", F.col("disk_id").alias("kept_disk"), "source").dropDuplicates(["path"])
    return upsert(kept, fresh, ["path", "member"])


def unlink_files(kept: DataFrame, paths: DataFrame) -> DataFrame:
    """``kept`` without the links of some files."""
    return kept.join(paths.select("path").distinct(), "path", "left_anti")


def relink(stored: DataFrame, stored_stamp: str, disks: DataFrame, images: DataFrame, stamp: str) -> tuple[DataFrame, str]:
    """Corrections or links carried over to a new snapshot, and its stamp; the same ones if the stamp has not changed, so it is done once.

    ``stored``: disk_id (of the old snapshot), payload columns, and ``identity``, the struct of ``identities`` that was
    stored with them. A row whose disc is gone keeps its identity with a NULL disc.
    """
    if stamp == stored_stamp:
        return stored, stamp
    wanted = stored.select(F.col("disk_id").alias("key"), "identity.*").dropDuplicates(["key"])
    found = find_discs(wanted, disks, images).select(F.col("key").alias("disk_id"), F.col("disk_id").alias("_now"))
    return stored.join(found, "disk_id", "left").withColumn("disk_id", F.col("_now")).drop("_now"), stamp
