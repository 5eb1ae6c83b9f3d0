"""Repeated byte strings by a distributed difference cover: sampled suffixes, names of triples, adjacent prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.llm.common import Scratch, real_id, row_ids
from spreadlab.llm.substring import repeated
from spreadlab.llm.tokens import PLACES, capped_counts, list_column, mixed, runs, winnowed

LENGTH = 200
GRAM = 64
#: Sampled suffixes of one first string that are merged within a task; more are dealt out by their windows.
HOT_GROUP = 20_000
MERGE_ROWS = 50_000

_BYTES = np.random.Generator(np.random.PCG64(20240608)).integers(0, 1 << 64, size=256, dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from each place on, by doubling; gram is a power of two."""
    out, size = _BYTES[data], 1
    while size < gram:
        out = out[:-size] * PLACES[size.bit_length()] + out[size:]
        size *= 2
    return mixed(out)


def sampled(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's cover and the hashes of their first `gram` bytes.

    The cover plays the part of the residues of a difference cover: of any two equal strings
    of `length` bytes, both have a place of the cover at a common offset, because a place is
    chosen as the least hash within such a string. It holds about 2 places in length - gram.
    """
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(data, gram)
    at = winnowed(hashes, length - gram + 1)
    return at, hashes[at]


def cover(length: int, gram: int):
    """Per text: number of bytes, digest, and hashes of its cover (twice if the text holds one twice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, found = [], [], []
            for first, last, data, bounds in runs(batch.column(2)):
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = data[a:b]
                    sizes.append(b - a)
                    digests.append(hashlib.sha256(own.tobytes()).digest())
                    found.append(capped_counts(sampled(own, length, gram)[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), list_column(found, pa.int64())], ["oid", "th", "n_bytes", "digest", "fps"]
            )

    return run


def suffixes(length: int, gram: int):
    """Sampled suffixes that recur in their first bytes: first-string hash, place, and the bytes on both sides."""
    side = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for first, last, data, bounds in runs(batch.column(2)):
                for row, a, b in zip(range(first, last), bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = data[a:b]
                    at, hashes = sampled(own, length, gram)
                    known = batch.column(3)[row].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    keep = np.isin(hashes, known)
                    text = own.tobytes()
                    oid, th = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                    for p, h in zip(at[keep].tolist(), hashes[keep].view(np.int64).tolist()):
                        rows.append((h, oid, th, p, text[max(0, p - side) : p], text[p + gram : p + length]))
                if len(rows) > MERGE_ROWS:
                    yield _suffix_batch(rows)
                    rows = []
            if rows:
                yield _suffix_batch(rows)

    return run


SUFFIX = pa.schema([("first", pa.int64()), ("oid", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("before", pa.binary()), ("after", pa.binary())])


def _suffix_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SUFFIX)], schema=SUFFIX)


def matrix(column: list[bytes], side: int, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes beside the sampled places as rows of one width, nearest first, and how many are real."""
    wide = -(-side // 24) * 24
    lengths = np.array([len(x) for x in column], np.int64)
    out = np.frombuffer(b"".join((x[::-1] if back else x).ljust(wide, b"\0") for x in column), np.uint8)
    return out.reshape(len(column), wide), lengths


def names(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows: triples of columns are sorted and named, and the names are ranked in turn."""
    while len(columns) > 1:
        upper = []
        for k in range(0, len(columns), 3):
            part = columns[k : k + 3]
            order = np.lexsort(part[::-1])
            new = np.zeros(len(order), bool)
            for c in part:
                s = c[order]
                new[1:] |= s[1:] != s[:-1]
            name = np.empty(len(order), np.int64)
            name[order] = np.cumsum(new)
            upper.append(name)
        columns = upper
    return columns[0]


def adjacent(block: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order within groups and the common prefix of each row with the one before (-1 across groups)."""
    rank = names(list(np.ascontiguousarray(block).view(">u8").astype(np.uint64).T))
    order = np.lexsort((rank, group))
    ordered = block[order]
    differ = ordered[1:] != ordered[:-1]
    common = np.full(len(order), -1, np.int64)
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), block.shape[1])
    common[1:][group[order][1:] != group[order][:-1]] = -1
    return order, common


def repeated_windows(first: np.ndarray, before: list[bytes], after: list[bytes], side: int) -> np.ndarray:
    """(side + 1, rows): whether the string that starts `offset` bytes before a sampled place occurs again.

    Sampled suffixes are ordered by what follows and by what precedes them; prefixes of
    neighbours give the classes at every depth. The string at an offset takes its class from
    the sampled suffix after it and the bytes in between, as remaining suffixes do in a merge.
    """
    left, n_left = matrix(before, side, back=True)
    right, n_right = matrix(after, side, back=False)
    l_order, l_common = adjacent(left, first)
    r_order, r_common = adjacent(right, first)
    out = np.zeros((side + 1, len(first)), bool)
    l_class, r_class = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
    for offset in range(side + 1):
        l_class[l_order] = np.cumsum(l_common < offset)
        r_class[r_order] = np.cumsum(r_common < side - offset)
        whole = np.flatnonzero((n_left >= offset) & (n_right >= side - offset))
        key = l_class[whole] * (len(first) + 1) + r_class[whole]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(whole), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        out[offset, whole] = again
    return out


def spans(flags: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes that the flagged strings of each sampled place cover."""
    edge = np.diff(np.pad(flags, ((1, 1), (0, 0))).astype(np.int8), axis=0)
    row, low = np.nonzero(edge.T == 1)
    row_, high = np.nonzero(edge.T == -1)
    return row, at[row] - (high - 1), at[row] - low + length


MARKS = "oid long, th long, start int, end int"


def merge(length: int, gram: int):
    """Spans of repeated strings from suffixes sorted by first-string hash; whole groups are merged together."""
    side = length - gram

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        flags = repeated_windows(t["first"].to_numpy(), t["before"].to_pylist(), t["after"].to_pylist(), side)
        row, start, end = spans(flags, t["at"].to_numpy().astype(np.int64), length)
        return pa.RecordBatch.from_arrays(
            [pa.array(t["oid"].to_numpy()[row]), pa.array(t["th"].to_numpy()[row]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["oid", "th", "start", "end"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) >= MERGE_ROWS:
                last = batch.column(0)[len(batch) - 1]
                whole = pa.Table.from_batches(held)
                cut_at = int(np.searchsorted(whole["first"].to_numpy(), last.as_py(), "left"))
                if cut_at:
                    yield solve(whole.slice(0, cut_at).combine_chunks().to_batches())
                    held = whole.slice(cut_at).combine_chunks().to_batches()
        if held:
            yield solve(held)

    return run


#: Neighbouring strings of a place that are told apart together; where they are not alike, the next smaller number.
STRIDES = (16, 4, 1)


def crowded_marks(alike: DataFrame, scratch: Scratch, length: int, gram: int) -> DataFrame:
    """(oid, th, start, end) of strings that recur around places of one first string, however many they are.

    `alike` has a row per different surroundings. The strings at neighbouring offsets low to
    high of a place lie in one outer string and share a core. Places with equal outer strings
    have all of them in common, a place whose core no other has shares none of them; one place
    of each outer string goes on with smaller strides where cores meet. The keys are two
    64-bit hashes, so that a clash among 10^12 strings has a chance of about 10^-15.
    """
    side = length - gram
    places = alike.select("first", "one.oid", "one.th", "one.at", "before", "after")
    found = None
    open_ = places.withColumn("low", F.explode(F.array(*[F.lit(k) for k in range(0, side + 1, STRIDES[0])])))
    for turn, stride in enumerate(STRIDES):
        high = F.least(F.col("low") + stride - 1, F.lit(side))
        lefts, rights = F.length("before"), F.length("after")
        left = lambda n: F.substring("before", F.greatest(lefts - n, F.lit(0)) + 1, F.greatest(n, F.lit(0)))
        right = lambda n: F.substring("after", F.lit(1), F.greatest(n, F.lit(0)))
        keys = lambda name, a, b: [F.xxhash64(F.lit(k), left(a), right(b), F.least(lefts, a)).alias(f"{name}{k}") for k in (1, 2)]
        # The strings that fit into the text: from `from_` to `upto`.
        rows = open_.where((F.col("low") <= lefts) & (high >= side - rights)).select(
            "first", "oid", "th", "at", "low",
            F.greatest("low", side - rights).alias("from_"), F.least(high, lefts).alias("upto"),
            *keys("outer", high, side - F.col("low")), *keys("core", F.col("low"), side - high),
        )
        rows = scratch.keep(rows, f"strings-{turn}")
        outer = ["first", "low", "outer1", "outer2"]
        classes = rows.groupBy(*outer).agg(F.count("*").alias("n"), F.min(F.struct("oid", "th", "at", "core1", "core2")).alias("one"))
        classes = scratch.keep(classes, f"classes-{turn}")
        marks = rows.join(classes.where("n > 1").select(*outer), outer).select("oid", "th", (F.col("at") - F.col("upto")).alias("start"), (F.col("at") - F.col("from_") + length).alias("end"))
        marks = scratch.keep(marks, f"marks-{turn}")
        found = marks if found is None else found.unionByName(marks)
        scratch.drop(f"strings-{turn}")
        if stride > 1:
            core = ["first", "low", "core1", "core2"]
            one = classes.select("first", "low", "one.*")
            meet = one.groupBy(*core).agg(F.count("*").alias("n")).where("n > 1").drop("n")
            smaller = STRIDES[turn + 1]
            lows = F.filter(F.transform(F.array(*[F.lit(k) for k in range(0, stride, smaller)]), lambda k: F.col("low") + k), lambda k: k <= side)
            on = one.join(meet, core).select("first", "oid", "th", "at", F.explode(lows).alias("low"))
            open_ = places.join(on, ["first", "oid", "th", "at"])
    return found


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text with marked spans: removed bytes, maximal runs, digest and bytes of the rest."""
    for batch in batches:
        removed, counts, digests, bounds_ = [], [], [], []
        for first, last, data, bounds in runs(batch.column(2)):
            for row, a, b in zip(range(first, last), bounds[:-1].tolist(), bounds[1:].tolist()):
                start, end = (batch.column(k)[row].values.to_numpy(zero_copy_only=False) for k in (3, 4))
                marks = np.bincount(start, minlength=b - a + 1) - np.bincount(end, minlength=b - a + 1)
                gone = np.cumsum(marks[: b - a]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                removed.append(int(gone.sum()))
                counts.append(len(edges) // 2)
                digests.append(hashlib.sha256(data[a:b][~gone].tobytes()).digest())
                bounds_.append(edges.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), list_column(bounds_, pa.int32())],
            ["oid", "th", "n_removed", "n_spans", "kept", "removed_spans"],
        )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot_group: int = HOT_GROUP) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed_spans.

    A byte goes when a string of `length` bytes covers it that also starts anywhere else, in
    another document or in the same one; strings are judged on the input and never cross
    documents. removed_spans holds the bounds of the removed runs in turn, null where nothing
    or, for an equal text, everything goes. Null and empty texts have no bytes. Rows of one id
    and equal text are one document; texts that differ under one id, and rows without an id,
    are documents of their own. Other columns are not read.

    Equal texts meet by digest: all of them go when long enough, and one stands for them in
    what follows. The suffixes at the places of the cover are sorted by names of triples, the
    strings between the places take their classes from them, and neighbours' prefixes say what
    occurs again. Only places whose first `gram` bytes recur take part: the others cannot lie
    in a repeated string. Places of one first string are merged in one task up to `hot_group`;
    beyond that places with the same bytes on both sides are met first, and one of them stands
    for its strings, which are told apart 16, 4 and 1 at a time, with counts formed before
    the shuffle.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    blank = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(row_ids(F.col(id_col), F.col(text_col)).alias("oid"), F.xxhash64(blank).alias("th"), blank.alias("text"))
    every = scratch.keep(texts.mapInArrow(cover(length, gram), "oid long, th long, n_bytes long, digest binary, fps array<long>"), "every")
    base = scratch.keep(every.select("oid", "th", "n_bytes", "digest"), "base")
    long = base.where(F.col("n_bytes") >= length)
    same = long.groupBy("digest").agg(F.min("oid").alias("first_id"), F.max("oid").alias("last_id"))
    leads = long.join(same, "digest").where("oid = first_id").select("oid", "th").distinct()
    fps = scratch.keep(every.select("oid", "th", "fps").join(leads, ["oid", "th"]).dropDuplicates(["oid", "th"]), "fps")
    scratch.drop("every")
    recurring = scratch.keep(repeated(fps), "recurring")
    scratch.drop("fps")
    hot = scratch.keep(texts.join(recurring, ["oid", "th"]).dropDuplicates(["oid", "th"]).select("oid", "th", "text", "recurring"), "texts")
    scratch.drop("recurring")

    found = hot.mapInArrow(suffixes(length, gram), "first long, oid long, th long, at int, before binary, after binary")
    found = scratch.keep(found, "suffixes")
    large = found.groupBy("first").agg(F.count("*").alias("n")).where(F.col("n") > hot_group).select("first")
    large = scratch.keep(large, "large")
    small = found.join(large, "first", "left_anti") if not large.isEmpty() else found
    marks = small.repartition("first").sortWithinPartitions("first").mapInArrow(merge(length, gram), MARKS)
    if not large.isEmpty():
        crowded = found.join(large, "first", "left_semi")
        alike = scratch.keep(crowded.groupBy("first", "before", "after").agg(F.count("*").alias("n"), F.min(F.struct("oid", "th", "at")).alias("one")), "alike")
        side = length - gram
        low, high = side - F.length("after"), F.length("before")
        whole = crowded.join(alike.where("n > 1").select("first", "before", "after"), ["first", "before", "after"]).where(low <= high)
        marks = marks.unionByName(whole.select("oid", "th", (F.col("at") - high).alias("start"), (F.col("at") - low + length).alias("end")))
        marks = marks.unionByName(crowded_marks(alike, scratch, length, gram))
    marks = scratch.keep(marks, "marks").groupBy("oid", "th").agg(F.collect_list(F.struct("start", "end")).alias("m")).select("oid", "th", F.col("m.start").alias("starts"), F.col("m.end").alias("ends"))
    scratch.drop("suffixes")
    done = hot.select("oid", "th", "text").join(marks, ["oid", "th"]).mapInArrow(cut, "oid long, th long, n_removed long, n_spans long, kept binary, removed_spans array<int>")

    out = base.select("oid", "th", "n_bytes", "digest").join(same, "digest", "left").join(done, ["oid", "th"], "left")
    whole = F.coalesce(F.col("first_id") < F.col("last_id"), F.lit(False))
    return out.select(
        real_id(F.col("oid")).alias("doc_id"),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.lower(F.hex(F.coalesce("kept", "digest")))).alias("kept_sha256"),
        "removed_spans",
    )
