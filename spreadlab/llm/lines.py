"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.llm.common import Scratch, real_id, row_ids

RUN = 2


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, kept_text, removed_lines.

    Lines are what newlines part; those with a word count (n_lines) and are compared as they
    stand, the others are passed over and stay. A line goes when `run` consecutive counting
    lines that include it also occur earlier: in a document of smaller id, or further up in
    the same one. Runs are judged on the input. removed_lines are places among the counting
    lines, ascending. Null and empty texts have no lines. Rows without an id come last, one
    document for each text; rows of one id and equal text are one document; texts that differ
    under one id share its place in the order but are cut by themselves.

    The fingerprint of a window of `run` lines is its least line hash, so equal windows have
    equal fingerprints whatever surrounds them. Only windows on fingerprints that occur at two
    places go on to the grouping by whole-window keys, where each is compared with the first of
    its kind; the fingerprints only thin the windows out. No positions are paired and no match
    is extended: overlapping windows cover a longer repeated run. Counts and minima are formed
    before the shuffle, so that a line which a third of all documents share is one row a task.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    blank = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(row_ids(F.col(id_col), F.col(text_col)).alias("oid"), F.xxhash64(blank).alias("th"), blank.alias("text"))
    lines = texts.select("oid", "th", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    hashed = lines.select("oid", "th", F.transform("lines", lambda x: F.md5(x.cast("binary"))).alias("h"), F.size("lines").alias("n")).where(F.col("n") >= run)
    part = lambda i: F.slice("h", i + 1, F.lit(run))
    least = lambda i: F.array_min(part(i))
    window = lambda i: F.struct(i.alias("start"), least(i).alias("fp"), (i + F.array_position(part(i), least(i)).cast("int")).alias("place"), F.array_join(part(i), "").alias("key"))
    windows = hashed.select("oid", "th", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - run), window)).alias("w")).select("oid", "th", "w.*").dropDuplicates(["oid", "th", "start"])
    windows = scratch.keep(windows, "windows")

    places = windows.select("fp", F.xxhash64("oid", "th", "place").alias("p"))
    shared = places.groupBy("fp").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a < b").select("fp")
    joined = windows.join(shared, "fp").select("oid", "th", "start", "key")
    here = F.struct("oid", "start")
    first = joined.groupBy("key").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first < last").select("key", "first")
    later = joined.join(first, "key").where(here > F.col("first"))
    gone = later.groupBy("oid", "th").agg(F.collect_set("start").alias("starts"))

    rows = texts.join(gone, ["oid", "th"], "left")
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + run - 1)))))
    all_lines = F.split("text", "\n")
    rows = rows.select("oid", all_lines.alias("all"), F.coalesce(covered, F.array().cast("array<int>")).alias("removed"))
    places = F.filter(F.transform("all", lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    rows = rows.select("oid", "all", "removed", places.alias("counting"))
    lost = F.transform("removed", lambda r: F.element_at("counting", r + 1))
    rows = rows.select("oid", "all", "removed", F.size("counting").cast("long").alias("n_lines"), F.array_except(F.sequence(F.lit(0), F.size("all") - 1), lost).alias("stay"))
    kept = F.array_join(F.transform("stay", lambda i: F.element_at("all", i + 1)), "\n")
    return rows.select(real_id(F.col("oid")).alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), kept.alias("kept_text"), F.col("removed").alias("removed_lines"))
