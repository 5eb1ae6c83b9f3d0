"""Importance resampling towards a target distribution of hashed word and pair features."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.llm.common import Scratch
from spreadlab.llm.ranks import most_frequent, ranked
from spreadlab.llm.tokens import Summary, runs

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
#: Frequent words and pairs that are broadcast: at most 12 and 20 bytes each.
HEAD_WORDS = 1 << 15
HEAD_PAIRS = 1 << 17
#: Distinct words and pairs that a task counts at a time; rarer ones are let go and stay in the tail.
SUMMARY = 1 << 18
SLOT_BITS, PAIR_BITS = 18, 21
SHORT = 8
#: Words longer than this go through zlib one by one.
STEPS = 48

INSIDE = np.zeros(256, dtype=bool)
INSIDE[0x30:0x3A] = INSIDE[0x41:0x5B] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(SHORT + 1)], np.uint64)


def crc_table() -> np.ndarray:
    """The 256 steps of the reflected polynomial 0xEDB88320."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> np.uint32(1)), step >> np.uint32(1))
    return step


CRC = crc_table()
OPENING = np.uint32(0xFFFFFFFF)


def after(state: np.ndarray, byte) -> np.ndarray:
    return CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def carried(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC states after further bytes: all words a byte at a time, very long ones alone."""
    import zlib

    state = state.copy()
    longest = int(lengths.max(initial=0))
    live = np.arange(len(starts))
    if longest > STEPS:
        far = np.flatnonzero(lengths > STEPS)
        for i in far.tolist():
            state[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        live = np.flatnonzero(lengths <= STEPS)
        longest = STEPS
    for k in range(longest):
        live = live[lengths[live] > k]
        if not len(live):
            break
        state[live] = after(state[live], data[starts[live] + k].astype(np.uint32))
    return state


def bucket_of(state: np.ndarray, buckets: int) -> np.ndarray:
    return ((state ^ OPENING) % np.uint32(buckets)).astype(np.int64)


class Spans:
    """Words of a run of texts: folded bytes, starts, lengths, `at` (first word of each text) and `key`.

    key is the word itself where it has at most eight bytes, else 0; no word holds a zero byte.
    """

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        self.data = np.concatenate([FOLD[raw], np.zeros(SHORT, np.uint8)])
        inside = INSIDE[raw]
        opens, closes = inside.copy(), inside.copy()
        if len(raw):
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            edge = bounds[(bounds > 0) & (bounds < len(raw))]
            opens[edge] = inside[edge]
            closes[edge - 1] = inside[edge - 1]
        self.starts = np.flatnonzero(opens)
        self.lengths = np.flatnonzero(closes) + 1 - self.starts
        self.at = np.searchsorted(self.starts, bounds)
        eight = np.ndarray((len(raw),), "<u8", self.data, 0, (1,)) if len(raw) else np.zeros(0, np.uint64)
        self.key = np.where(self.lengths <= SHORT, eight[self.starts] & _MASKS[np.minimum(self.lengths, SHORT)], np.uint64(0))

    def pairs(self) -> np.ndarray:
        """First words of the pairs that lie in one text."""
        whole = np.ones(max(len(self.starts) - 1, 0), bool)
        last = self.at[1:] - 1
        whole[last[(last >= 0) & (last < len(whole))]] = False
        return np.flatnonzero(whole)


def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, second, n) of a task's frequent short words (second 0) and pairs of them."""
    words, pairs = Summary(SUMMARY), Summary(SUMMARY)
    for batch in batches:
        for _, _, raw, bounds in runs(batch.column(0)):
            spans = Spans(raw, bounds)
            known = spans.key[spans.key > 0]
            words.add(known, np.zeros(len(known), np.uint64))
            j = spans.pairs()
            j = j[(spans.key[j] > 0) & (spans.key[j + 1] > 0)]
            pairs.add(spans.key[j], spans.key[j + 1])
    for most, kept in ((HEAD_WORDS, words), (HEAD_PAIRS, pairs)):
        first, second, n = kept.merge()
        top = np.argsort(-n, kind="stable")[: 2 * most]
        yield pa.RecordBatch.from_arrays([pa.array(first[top].view(np.int64)), pa.array(second[top].view(np.int64)), pa.array(n[top].astype(np.int64))], ["first", "second", "n"])


class Head:
    """Frequent words by their slot with the CRC state after them, frequent pairs with their bucket."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, buckets: int):
        self.buckets = buckets
        self.key, self.state = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.uint32)
        self.pair, self.bucket = np.zeros(1 << PAIR_BITS, np.uint64), np.zeros(1 << PAIR_BITS, np.int64)
        # Where two words or pairs want one slot, the more frequent one has it; the other one stays in the tail.
        slot = self.slot(words)
        self.key[slot[::-1]] = words[::-1]
        letters = words.view(np.uint8).reshape(-1, SHORT)
        self.state[slot] = carried(np.full(len(words), OPENING), letters.ravel(), np.arange(len(words)) * SHORT, (letters > 0).sum(axis=1))[self.owner(slot, words)]
        mark, known = self.pair_mark(self.slot(pairs[:, 0]), self.slot(pairs[:, 1])), self.knows(pairs[:, 0]) & self.knows(pairs[:, 1])
        pairs, mark = pairs[known], mark[known]
        at = self.pair_slot(mark)
        self.pair[at[::-1]] = mark[::-1]
        letters = np.ascontiguousarray(pairs[:, 1]).view(np.uint8).reshape(-1, SHORT)
        spaced = after(self.state[self.slot(pairs[:, 0])], np.uint32(32))
        state = carried(spaced, letters.ravel(), np.arange(len(pairs)) * SHORT, (letters > 0).sum(axis=1))
        mine = self.pair[at] == mark
        self.bucket[at[mine]] = bucket_of(state, buckets)[mine]

    def owner(self, slot: np.ndarray, words: np.ndarray) -> np.ndarray:
        """For each word the place of the word that holds its slot."""
        place = np.zeros(1 << SLOT_BITS, np.int64)
        place[slot[::-1]] = np.arange(len(words))[::-1]
        return place[slot]

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _SPREAD) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def knows(self, key: np.ndarray) -> np.ndarray:
        return (self.key[self.slot(key)] == key) & (key > 0)

    def pair_mark(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return (one.astype(np.uint64) << np.uint64(SLOT_BITS)) + two.astype(np.uint64) + np.uint64(1)

    def pair_slot(self, mark: np.ndarray) -> np.ndarray:
        return ((mark * _SPREAD) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def features(self, spans: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all words, first words of all pairs, buckets of all pairs."""
        slot, known = self.slot(spans.key), self.knows(spans.key)
        state = self.state[slot]
        tail = np.flatnonzero(~known)
        state[tail] = carried(np.full(len(tail), OPENING), spans.data, spans.starts[tail], spans.lengths[tail])
        j = spans.pairs()
        mark = self.pair_mark(slot[j], slot[j + 1])
        at = self.pair_slot(mark)
        found = known[j] & known[j + 1] & (self.pair[at] == mark)
        buckets = self.bucket[at]
        rest = j[~found]
        spaced = after(state[rest], np.uint32(32))
        buckets[~found] = bucket_of(carried(spaced, spans.data, spans.starts[rest + 1], spans.lengths[rest + 1]), self.buckets)
        return bucket_of(state, self.buckets), j, buckets


def totals(head):
    """(bucket, n) of a task's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = head.value
        table = Head(*table)
        n = np.zeros(table.buckets, np.int64)
        for batch in batches:
            for _, _, raw, bounds in runs(batch.column(0)):
                words, _, pairs = table.features(Spans(raw, bounds))
                n += np.bincount(words, minlength=table.buckets) + np.bincount(pairs, minlength=table.buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    return run


def weights(head, gains):
    """Per text: words, features and the floored mean of their gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, gain = Head(*head.value), gains.value
        for batch in batches:
            counts, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, raw, bounds in runs(batch.column(1)):
                spans = Spans(raw, bounds)
                words, j, pairs = table.features(spans)
                of_pair = np.zeros(len(words), np.int64)
                of_pair[j] = gain[pairs]
                upto = np.concatenate([[0], np.cumsum(gain[words] + of_pair)])
                counts.append(np.diff(spans.at))
                sums.append(upto[spans.at[1:]] - upto[spans.at[:-1]])
            n, total = np.concatenate(counts), np.concatenate(sums)
            features = np.maximum(2 * n - 1, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(features), pa.array(total // np.maximum(features, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def head_of(docs: DataFrame, text_col: str, scratch: Scratch, buckets: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent short words and pairs of all texts: at most HEAD_WORDS and HEAD_PAIRS rows come to the driver.

    A task gives its frequent ones. Which words are in the head decides how a CRC is found, not what it is.
    """
    seen = docs.select(F.col(text_col).alias("text")).mapInArrow(frequent, "first long, second long, n long")
    counts = scratch.keep(seen.groupBy("first", "second").agg(F.sum("n").alias("n")), "frequent")
    top = lambda rows, most: sorted(most_frequent(rows, most).collect(), key=lambda r: (-r["n"], r["first"], r["second"]))
    words, pairs = top(counts.where("second = 0"), HEAD_WORDS), top(counts.where("second != 0"), HEAD_PAIRS)
    scratch.drop("frequent")
    return np.array([r["first"] for r in words], np.int64).view(np.uint64), np.array([(r["first"], r["second"]) for r in pairs], np.int64).reshape(-1, 2).view(np.uint64), buckets


def bucket_totals(docs: DataFrame, text_col: str, head, buckets: int) -> np.ndarray:
    """Exact counts of all features in the buckets: at most `buckets` rows come to the driver."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(totals(head), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gain_table(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over its share in the documents."""
    n, s_all, t_all = len(raw), float(raw.sum()) + len(raw), float(target.sum()) + len(raw)
    return np.array([math.floor(1000 * math.log((float(target[k]) + 1) * s_all / ((float(raw[k]) + 1) * t_all))) for k in range(n)], np.int64)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_features, weight, score, rank.

    Words are runs of ASCII letters and digits, folded, and of all characters beyond ASCII;
    features are words and pairs of neighbours. A null or empty text has none and weight 0. The
    weight is the floored mean of the features' gains; the score adds Gumbel noise that follows
    from seed and doc_id. Of the rows with `least_words` words the highest `percent` in a
    hundred are drawn (floored), ties to the smaller id, a null id last; rows that agree in both
    share their ranks in any order. rank is null for rows that are not drawn. Other columns are
    not read. An empty target has uniform shares; an empty table gives no rows.

    Frequent words and pairs are broadcast with their CRC states and buckets; all others
    continue a CRC over their bytes, many words at a time. Both give the same exact buckets.
    What tasks hold does not depend on the data: runs of texts and tables of fixed size.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resample")
    head = spark.sparkContext.broadcast(head_of(docs, text_col, scratch, buckets))
    gains = spark.sparkContext.broadcast(gain_table(bucket_totals(docs, text_col, head, buckets), bucket_totals(target, target_col, head, buckets)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    weighed = rows.mapInArrow(weights(head, gains), "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = scratch.keep(weighed.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")

    fit = F.col("n_words") >= least_words
    draws = percent * scored.where(fit).count() // 100
    places = ranked(scratch, scored.where(fit), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "ranges")
    drawn = places.withColumn("rank", F.when(F.col("place") < draws, F.col("place") + 1).cast("long"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return drawn.select(*columns).unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")).select(*columns))
