"""Best-fit packing of documents into sequences, with conflicts between documents."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.llm.common import Scratch, n_words, without_blanks

CAPACITY = 2048
SOURCE_SLOTS = 4
SHARD_PIECES = 4096
CLUSTER_BITS = 256
SOURCE_BITS = 64

COLUMNS = "doc_id {id}, piece int, first_word long, n_words long, bin string, bin_offset long, bin_words long"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, slots: int) -> list[tuple[int, int]]:
    """(bin, offset) of every piece; pieces come in falling size.

    Open bins stand in the order of what is left in them. The search starts at the tightest
    bin that takes the piece and goes to the next larger one while the bin's bitmaps conflict:
    its cluster bitmap has the piece's cluster bit, or all `slots` source bitmaps have the
    source's bit. A new bin opens when none is left.
    """
    order: list[tuple[int, int]] = []
    used: list[int] = []
    cluster_map: list[int] = []
    source_maps: list[list[int]] = []
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters):
        at = bisect_left(order, (size, -1))
        source_bit, cluster_bit = 1 << source, 1 << cluster
        while at < len(order):
            chosen = order[at][1]
            if not cluster_map[chosen] & cluster_bit and not source_maps[chosen][slots - 1] & source_bit:
                break
            at += 1
        if at < len(order):
            del order[at]
        else:
            chosen = len(used)
            used.append(0)
            cluster_map.append(0)
            source_maps.append([0] * slots)
        placed.append((chosen, used[chosen]))
        used[chosen] += size
        cluster_map[chosen] |= cluster_bit
        planes = source_maps[chosen]
        free = next(k for k in range(slots) if not planes[k] & source_bit)
        planes[free] |= source_bit
        insort(order, (capacity - used[chosen], chosen))
    return placed


def pack_shard(capacity: int, slots: int):
    def pack(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["n_words", "tie", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        placed = best_fit(pieces["n_words"].tolist(), pieces["source_bit"].tolist(), pieces["cluster_bit"].tolist(), capacity, slots)
        out = pieces[["doc_id", "piece", "first_word", "n_words"]].copy()
        shard = pieces["shard"].iloc[0]
        out["bin"] = [f"{shard}-{b}" for b, _ in placed]
        out["bin_offset"] = [o for _, o in placed]
        out["bin_words"] = out.groupby("bin")["n_words"].transform("sum")
        return out

    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, source_slots: int = SOURCE_SLOTS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, n_words, bin, bin_offset, bin_words.

    A document of more than `capacity` words is cut into pieces of `capacity` words and a
    rest; all its words are packed. A document without words (null or empty text) is one piece
    of no words. A bin holds at most `capacity` words, no two texts that are equal without
    blanks (so no row twice), and at most `source_slots` pieces of one source. Clusters and
    sources are bits of bitmaps, so a chance match of bits only sends a piece to another bin.
    A null source is a source; rows that tie are packed one after the other.

    Pieces are dealt to shards of about `shard_pieces` by a hash of the row's running number,
    which no two rows share, and each shard is packed by itself: no shard grows with the data,
    with rows without an id or with rows of one id, and no source and no cluster is gathered.
    Bins follow from the order of the input's files.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    key = F.xxhash64(without_blanks(F.col(text_col)))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        n_words(F.col(text_col)).alias("size"),
        F.pmod(F.xxhash64(F.coalesce(F.col(source_col), F.lit("\x00"))), F.lit(SOURCE_BITS)).cast("int").alias("source_bit"),
        key.alias("cluster"),
        F.monotonically_increasing_id().alias("row"),
    )
    sized = scratch.keep(sized, "sized")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("int"))))
    total = sized.agg(F.sum(F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_pieces))
    first = F.col("piece").cast("long") * capacity
    pieces = pieces.select(
        "doc_id",
        "piece",
        first.alias("first_word"),
        F.least(F.col("size") - first, F.lit(capacity)).alias("n_words"),
        "source_bit",
        F.pmod(F.xxhash64("cluster"), F.lit(CLUSTER_BITS)).cast("int").alias("cluster_bit"),
        F.xxhash64("doc_id", "piece").alias("tie"),
        "row",
        F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"),
    )
    id_type = docs.schema[id_col].dataType.simpleString()
    return pieces.groupBy("shard").applyInPandas(pack_shard(capacity, source_slots), COLUMNS.format(id=id_type))
