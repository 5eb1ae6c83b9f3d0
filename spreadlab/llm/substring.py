"""Substring dedup: recurring passages located by Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.llm.common import Scratch, real_id, row_ids
from spreadlab.llm.tokens import Words, capped_counts, list_column, runs, winnowed

WINDOW = 20
PHRASE = 6
SHARD_BYTES = 2 << 20


def joined(words: Words, row: int) -> tuple[bytes, np.ndarray]:
    """The words of a text between single spaces, and where each of them starts."""
    first, last = words.at[row], words.at[row + 1]
    starts, ends = words.starts[first:last], words.ends[first:last]
    lengths = ends - starts
    places = np.cumsum(lengths + 1) - lengths - 1
    out = np.full(int(lengths.sum()) + max(len(lengths) - 1, 0), 32, np.uint8)
    if len(lengths):
        inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(places, lengths) + inner] = words.data[np.repeat(starts, lengths) + inner]
    return out.tobytes(), places


def fingerprints(window: int, phrase: int):
    """Per text: number of words, digest of its words, and its fingerprints.

    A fingerprint is the hash of `phrase` words that is least among those in some window of
    `window` words, so equal windows share one; it stands twice if the text holds it twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, found = [], [], []
            for first, last, data, bounds in runs(batch.column(2)):
                words = Words(data, bounds)
                hashes = words.windows(phrase)
                for row in range(last - first):
                    a, b = words.at[row], words.at[row + 1]
                    own = hashes[a : max(a, b - phrase + 1)]
                    counts.append(int(b - a))
                    digests.append(hashlib.sha256(joined(words, row)[0]).digest())
                    found.append(capped_counts(own[winnowed(own, window - phrase + 1)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), list_column(found, pa.int64())], ["oid", "th", "n_words", "digest", "fps"]
            )

    return run


def locate(window: int, phrase: int):
    """Per text: the windows that hold a recurring phrase, found by the automaton of its shard.

    The phrases that recur (their hashes came with the texts) are confirmed by their words and
    compiled into one automaton a shard of texts; every text of the shard streams through it,
    and each hit marks the windows around it. `again` are starts of windows that the same text
    holds earlier; `keys` and `starts` give each of its other marked windows once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recurring = batch.column(3)
            starts, keys, again = [], [], []
            for first, last, data, bounds in runs(batch.column(2), SHARD_BYTES):
                words = Words(data, bounds)
                hashes, spans = words.windows(phrase), words.windows(window)
                texts = [joined(words, row) for row in range(last - first)]
                automaton = ahocorasick.Automaton()
                for row, (text, places) in enumerate(texts):
                    a, b = words.at[row], words.at[row + 1]
                    known = recurring[first + row].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    at = np.flatnonzero(np.isin(hashes[a : max(a, b - phrase + 1)], known))
                    ends = np.append(places[1:] - 1, len(text))
                    for p, q in zip(places[at].tolist(), ends[at + phrase - 1].tolist()):
                        automaton.add_word(f" {text[p:q].decode('latin-1')} ", q - p)
                if len(automaton):
                    automaton.make_automaton()
                for row, (text, places) in enumerate(texts):
                    n = len(places)
                    marks = np.zeros(n + 1, np.int32)
                    if len(automaton) and n >= window:
                        hits = np.array([end - length - 1 for end, length in automaton.iter(f" {text.decode('latin-1')} ")], np.int64)
                        word = np.searchsorted(places, hits)
                        np.add.at(marks, np.maximum(word + phrase - window, 0), 1)
                        np.add.at(marks, np.minimum(word + 1, n), -1)
                    marked = np.flatnonzero(np.cumsum(marks[: max(n - window + 1, 0)]) > 0)
                    key = spans[words.at[row] + marked]
                    _, fresh = np.unique(key, return_index=True)
                    fresh.sort()
                    starts.append(marked[fresh].astype(np.int32))
                    keys.append(key[fresh])
                    again.append(np.delete(marked, fresh).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), list_column(starts, pa.int32()), list_column(keys, pa.int64()), list_column(again, pa.int32())],
                ["oid", "th", "starts", "keys", "again"],
            )

    return run


def cut(window: int):
    """Per text: removed word spans and the text of what is left, from the starts of later windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, left = [], [], []
            for first, last, data, bounds in runs(batch.column(2)):
                words = Words(data, bounds)
                for row in range(last - first):
                    text, places = joined(words, row)
                    n = len(places)
                    marks = np.zeros(n + window + 1, np.int32)
                    for column in (3, 4):
                        if batch.column(column)[first + row].is_valid:
                            at = batch.column(column)[first + row].values.to_numpy(zero_copy_only=False)
                            np.add.at(marks, at, 1)
                            np.add.at(marks, at + window, -1)
                    gone = np.cumsum(marks[:n]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    ends = np.append(places[1:] - 1, len(text))
                    removed.append(int(gone.sum()))
                    spans.append(edges.astype(np.int32))
                    left.append(b" ".join(text[p:q] for p, q in zip(places[~gone].tolist(), ends[~gone].tolist())).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), list_column(spans, pa.int32()), pa.array(left, pa.string())],
                ["oid", "th", "n_removed", "removed_spans", "kept_text"],
            )

    return run


def repeated(fps: DataFrame) -> DataFrame:
    """Per row of (oid, th, fps): the fingerprints that occur twice or more in all rows."""
    counts = fps.select(F.explode("fps").alias("fp")).groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    held = fps.select("oid", "th", F.explode(F.array_distinct("fps")).alias("fp"))
    return held.join(counts, "fp").groupBy("oid", "th").agg(F.collect_list("fp").alias("recurring"))


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, removed_spans.

    A word goes when a window of `window` consecutive words covers it whose words also start
    earlier: in a document of smaller id, or before in the same one. Windows are judged on the
    input. removed_spans holds the bounds of the removed runs of words in turn, null where
    nothing or everything goes. Null and empty texts have no words. Rows without an id come
    after all others. Rows of one id and equal text are one document; texts that differ under
    one id share its place in the order but are cut by themselves. Other columns are not read.

    Documents of equal words meet by digest first: all but the smallest id go as a whole and
    take no further part. Of the others, fingerprints that recur bring their texts to the
    automata; the windows found there meet by hash, where the smallest id of each keeps it.
    Sums and minima are formed before each shuffle, so a passage that a third of all
    documents share is no larger than another.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    blank = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(row_ids(F.col(id_col), F.col(text_col)).alias("oid"), F.xxhash64(blank).alias("th"), blank.alias("text"))
    whole = scratch.keep(texts.mapInArrow(fingerprints(window, phrase), "oid long, th long, n_words long, digest binary, fps array<long>"), "whole")
    base = scratch.keep(whole.select("oid", "th", "n_words", "digest"), "base")
    first = base.where(F.col("n_words") >= window).groupBy("digest").agg(F.min("oid").alias("first_id"))
    leads = base.join(first, "digest").where((F.col("n_words") >= window) & (F.col("oid") == F.col("first_id"))).select("oid", "th")
    fps = scratch.keep(whole.select("oid", "th", "fps").join(leads.distinct(), ["oid", "th"]).dropDuplicates(["oid", "th"]), "fps")
    scratch.drop("whole")
    recurring = scratch.keep(repeated(fps), "recurring")
    scratch.drop("fps")
    hot = scratch.keep(texts.join(recurring, ["oid", "th"]).dropDuplicates(["oid", "th"]).select("oid", "th", "text", "recurring"), "texts")
    scratch.drop("recurring")
    found = scratch.keep(hot.mapInArrow(locate(window, phrase), "oid long, th long, starts array<int>, keys array<long>, again array<int>"), "found")

    rows = found.select("oid", "th", F.explode(F.arrays_zip("keys", "starts")).alias("k")).select("oid", "th", F.col("k.keys").alias("key"), F.col("k.starts").alias("start"))
    owners = rows.groupBy("key").agg(F.min("oid").alias("owner"), F.max("oid").alias("other")).where("owner < other").select("key", "owner")
    owners = scratch.keep(owners, "owners")
    later = rows.join(owners, "key").where("oid > owner").groupBy("oid", "th").agg(F.collect_list("start").alias("later"))
    again = found.where(F.size("again") > 0).select("oid", "th", "again")
    marks = scratch.keep(later.join(again, ["oid", "th"], "full_outer"), "marks")
    scratch.drop("owners", "found")
    done = hot.select("oid", "th", "text").join(marks, ["oid", "th"]).mapInArrow(cut(window), "oid long, th long, n_removed long, removed_spans array<int>, kept_text string")
    done = done.select("oid", "th", "n_removed", "removed_spans", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept"))

    copy = (F.col("n_words") >= window) & (F.col("oid") > F.col("first_id"))
    out = base.join(first, "digest", "left").join(done, ["oid", "th"], "left")
    return out.select(
        real_id(F.col("oid")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", F.lower(F.hex("digest")))).alias("kept_sha256"),
        "removed_spans",
    )
