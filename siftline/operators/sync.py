"""Keeping the index in step: diffs of listings, quick sync, change journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.paths import parent_of, under_roots

# fixed values: bits of a change journal's flags
HISTORY_DONE, MUST_SCAN, CREATED, REMOVED, RENAMED, MODIFIED, IS_FILE = 0x10, 0x1, 0x100, 0x200, 0x800, 0x1000, 0x10000

#: Complete roots that come to the driver, at most.
MAX_ROOTS = 10_000


def diff_new(scanned: DataFrame, indexed: DataFrame) -> DataFrame:
    return scanned.join(indexed.select("path"), "path", "left_anti")


def diff_modified(scanned: DataFrame, indexed: DataFrame) -> DataFrame:
    """Scanned rows that are strictly newer than the indexed ones."""
    had = indexed.select("path", F.col("modified_ts").alias("had"))
    return scanned.join(had, "path").filter("modified_ts > had").drop("had")


def diff_deleted(scanned: DataFrame, indexed: DataFrame, complete_roots: DataFrame) -> DataFrame:
    """Indexed rows not seen by the scan, below roots whose walk was complete only; more than MAX_ROOTS roots (root) are joined."""
    gone = indexed.join(scanned.select("path"), "path", "left_anti")
    roots = [r[0] for r in complete_roots.select("root").distinct().limit(MAX_ROOTS + 1).collect()]
    if len(roots) <= MAX_ROOTS:
        return gone.filter(under_roots(F.col("path"), roots))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i - 1), "/"), F.when(i > 1, "/").otherwise("")))
    places = gone.select("path", F.explode(F.concat(F.array("path"), F.slice(above, 2, F.size(parts)))).alias("root"))
    keys = complete_roots.select(F.explode(F.array("root", F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/")))).alias("root"))
    return gone.join(places.join(keys, "root", "left_semi").select("path"), "path", "left_semi")


def changed_for_content(new: DataFrame, modified: DataFrame) -> DataFrame:
    return new.select("path", "filename", "extension").unionByName(modified.select("path", "filename", "extension"))


def pruned_listing(listing: DataFrame, last_max: int, depth: int = 5) -> DataFrame:
    """Files that a quick sync lists: below ``depth`` only those in directories changed after the last sync."""
    dirs = listing.filter("is_dir").select(F.col("path").alias("parent"), F.col("modified_ts").alias("dir_ts"))
    files = listing.filter("not is_dir").withColumn("parent", parent_of(F.col("path")))
    deep = F.size(F.split("parent", "/")) - 1 > depth
    return files.join(dirs, "parent", "left").filter(~deep | F.col("dir_ts").isNull() | (F.col("dir_ts") > last_max)).drop("parent", "dir_ts")


def quick_sync(listing: DataFrame, indexed: DataFrame, hot_roots: list[str], last_max: int, complete_roots: DataFrame) -> DataFrame:
    """(path, change): ``added`` and ``modified`` of the hot folders and the pruned listing, each once, and ``deleted``."""
    seen = listing.filter("not is_dir").filter(under_roots(F.col("path"), hot_roots)).unionByName(pruned_listing(listing, last_max)).dropDuplicates(["path"])
    added = diff_new(seen, indexed).select("path", F.lit("added").alias("change"))
    modified = diff_modified(seen, indexed).select("path", F.lit("modified").alias("change"))
    deleted = diff_deleted(listing, indexed.filter("not is_dir"), complete_roots).select("path", F.lit("deleted").alias("change"))
    return added.unionByName(modified).unionByName(deleted)


def journal_flags(flags: Column) -> Column:
    """A struct of the change flags of a journal entry; null for the end of history and for entries that say nothing of a file."""
    bit = lambda b: F.getbit(flags, F.lit(b.bit_length() - 1)) == 1
    scan = bit(MUST_SCAN)
    some = bit(CREATED) | bit(MODIFIED) | bit(REMOVED) | bit(RENAMED)
    named = [F.when(scan, F.lit(False)).otherwise(bit(b)).alias(n) for n, b in (("created", CREATED), ("modified", MODIFIED), ("removed", REMOVED), ("renamed", RENAMED))]
    return F.when(~bit(HISTORY_DONE) & (scan | (bit(IS_FILE) & some)), F.struct(*named, scan.alias("must_scan_dir")))


def journal_apply(changes: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Updates (rows of the listing) and deletes (paths) of journal changes (event_id, path, flags...).

    The last change of a path holds. What still exists is an update, whatever was said of it; a removed or renamed path that
    does not is a delete; a directory that must be scanned updates the files directly in it.
    """
    flags = F.struct("event_id", "created", "modified", "removed", "renamed", "must_scan_dir")
    last = changes.filter("path is not null").groupBy("path").agg(F.max_by(flags, "event_id").alias("c")).select("path", "c.*")
    scan = last.filter("must_scan_dir").select(F.col("path").alias("parent"))
    plain = last.filter("not must_scan_dir")
    inside = listing.filter("not is_dir").withColumn("parent", parent_of(F.col("path"))).join(scan, "parent", "left_semi").drop("parent")
    updates = listing.join(plain.select("path"), "path", "left_semi").unionByName(inside).dropDuplicates(["path"])
    deletes = plain.filter("removed or renamed").join(listing.select("path"), "path", "left_anti").select("path")
    return updates, deletes


def drifted(indexed_docs: int, expected: int) -> bool:
    """Whether the content index holds so few of the documents expected that it should be rebuilt."""
    return expected > 0 and indexed_docs < 0.85 * expected


def older(then: int | None, now: int, seconds: int) -> bool:
    """Whether a time is unknown or at least so many seconds ago."""
    return then is None or now - then >= seconds
