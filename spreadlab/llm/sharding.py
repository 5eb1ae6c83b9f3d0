"""Sharding by balanced label propagation: documents move to the shards of the documents they are linked to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.llm.common import Scratch, real_id, row_ids
from spreadlab.llm.ranks import ranked

SHARDS = 8
TURNS = 8
PASSES = 6
#: Hash blocks of a stream of moves: a quota is spent block by block, and row by row in the block where it ends.
BLOCKS = 1024
#: Shards that differ from the mean by less than this share of it are even.
EVEN = 0.0005
#: A shard takes part as a goal while it has at least this share of the mean left.
OPEN = 0.002

GROUP = ("h", "crc", "size")


def flows(wishes: dict[tuple[int, int], float], rooms: list[float]) -> dict[tuple[int, int], float]:
    """What may move from shard to shard so that no shard takes in more than its room and what leaves it.

    Wishes into a shard that would overflow are cut in proportion; that makes less leave
    elsewhere, so it is repeated until nothing changes. The table has a row per pair of shards.
    """
    left = dict(wishes)
    for _ in range(200):
        cut = False
        for j, room in enumerate(rooms):
            into = sum(v for (_, b), v in left.items() if b == j)
            out = sum(v for (a, _), v in left.items() if a == j)
            if into > max(room + out, 0) + 0.5:
                share, cut = max(room + out, 0) / into, True
                left = {k: v * share if k[1] == j else v for k, v in left.items()}
        if not cut:
            break
    return {k: v for k, v in left.items() if v >= 1}


def surplus_flows(loads: list[float], goals: list[float]) -> dict[tuple[int, int], float]:
    """Streams from shards above their goals to those below, largest first."""
    over = sorted(((v - g, j) for j, (v, g) in enumerate(zip(loads, goals)) if v > g), reverse=True)
    under = sorted(((g - v, j) for j, (v, g) in enumerate(zip(loads, goals)) if v < g), reverse=True)
    streams = {}
    while over and under:
        (a, i), (b, j) = over[0], under[0]
        take = min(a, b)
        if take >= 1:
            streams[(i, j)] = take
        over = sorted([*over[1:], *([(a - take, i)] if a - take > 0.5 else [])], reverse=True)
        under = sorted([*under[1:], *([(b - take, j)] if b - take > 0.5 else [])], reverse=True)
    return streams


def quota_of(streams: dict[tuple[int, int], float], shards: int) -> Column:
    """The quota of a row's stream (shard, to), from a literal of shards x shards numbers."""
    table = F.array(*[F.lit(float(streams.get((i, j), 0.0))) for i in range(shards) for j in range(shards)])
    return F.element_at(table, F.col("shard") * shards + F.col("to") + 1)


def moved(cells: DataFrame, streams: dict[tuple[int, int], float], shards: int) -> DataFrame:
    """Cells after their moves, from cells with `to` (null: stays) and `urge` (most urgent first).

    In a stream the cells stand by urge, hash block and hash. Bytes before a block are summed
    over blocks, those before a cell inside its block; a cell moves as many documents as the
    quota still takes.
    """
    wish = cells.where("to is not null").withColumn("quota", quota_of(streams, shards)).where("quota > 0")
    wish = wish.withColumn("block", F.pmod(F.xxhash64(*GROUP), F.lit(BLOCKS)))
    stream, block = ["shard", "to"], ["shard", "to", "urge", "block"]
    sums = wish.groupBy(*block).agg(F.sum(F.col("n") * F.col("size")).alias("bytes"))
    before = Window.partitionBy(*stream).orderBy(F.col("urge").desc(), "block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0))).drop("bytes")
    inside = Window.partitionBy(*block).orderBy(*GROUP).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0))
    goes = F.greatest(F.least(F.col("n"), F.floor((F.col("quota") - spent) / F.col("size"))), F.lit(0))
    gone = wish.join(sums, block).select(*GROUP, "shard", "to", goes.cast("long").alias("n")).where("n > 0")
    change = gone.select(*GROUP, "shard", (-F.col("n")).alias("n")).unionByName(gone.select(*GROUP, F.col("to").alias("shard"), "n"))
    return cells.select(*GROUP, "shard", "n").unionByName(change).groupBy(*GROUP, "shard").agg(F.sum("n").alias("n")).where("n > 0")


def loads_of(cells: DataFrame, shards: int) -> list[float]:
    """Bytes per shard: one row each."""
    found = dict(cells.groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).cast("double").alias("b")).collect())
    return [found.get(j, 0.0) for j in range(shards)]


def pinned(start: DataFrame, shards: int) -> tuple[list[tuple], list[float]]:
    """Documents above an even share, a shard of their own each, and the goals of all shards.

    There are fewer of them than shards; what is left is shared evenly by the other shards.
    """
    total = start.agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 0
    largest = start.groupBy(*GROUP).agg(F.sum("n").alias("n")).orderBy(F.col("size").desc(), "h", "crc").limit(shards).collect()
    sizes = [r for r in largest for _ in range(min(r["n"], shards))][:shards]
    held, goals = [], []
    while len(held) < min(shards - 1, len(sizes)) and sizes[len(held)]["size"] * (shards - len(held)) > total - sum(goals):
        row = sizes[len(held)]
        goals.append(float(row["size"]))
        held.append((row["h"], row["crc"], row["size"], len(held), 1))
    even = (total - sum(goals)) / (shards - len(held))
    for r in largest:
        more = r["n"] - sum(x[:3] == (r["h"], r["crc"], r["size"]) for x in held)
        if 0 < more < r["n"]:
            held.append((r["h"], r["crc"], r["size"], shards - 1, more))
    return held, goals + [even] * (shards - len(goals))


def propagate(linked: DataFrame, goals: list[float], shards: int, turns: int, scratch: Scratch) -> DataFrame:
    """Cells (group, shard, n) after the propagation of labels.

    Every turn joins the cells of a group: its documents vote for the shard that holds most of
    them and still has room, and documents elsewhere wish to go there. What moves is what the
    quotas allow, those with most neighbours there a byte first. It ends when nothing moves.
    """
    cells = scratch.keep(linked, "turn-0")
    for turn in range(turns):
        loads = loads_of(cells, shards)
        # A shard with a document above an even share takes no others.
        rooms = [goals[-1] - v if g == goals[-1] else -v for v, g in zip(loads, goals)]
        open_ = F.array(*[F.lit(r >= OPEN * goals[-1] and r > 0) for r in rooms])
        whole = Window.partitionBy(*GROUP)
        vote = F.struct("n", F.xxhash64(*GROUP, "shard").alias("tie"), "shard")
        # At most `shards` rows share a group here.
        best = F.max(F.when(F.element_at(open_, F.col("shard") + 1), vote)).over(whole)
        wish = cells.withColumn("best", best).withColumn("to", F.when((F.col("best.shard") != F.col("shard")) & (F.col("best") > vote), F.col("best.shard")))
        wish = wish.withColumn("urge", F.floor(F.log2(F.col("best.n") * 1024.0 / F.col("size"))).cast("int")).drop("best")
        asked = wish.where("to is not null").groupBy("shard", "to").agg(F.sum(F.col("n") * F.col("size")).cast("double").alias("b"))
        streams = flows({(r["shard"], r["to"]): r["b"] for r in asked.collect()}, rooms)
        if not streams:
            break
        cells = scratch.keep(moved(wish, streams, shards), f"turn-{turn + 1}")
        scratch.drop(f"turn-{turn}")
    return cells


def evened(cells: DataFrame, goals: list[float], shards: int, passes: int, scratch: Scratch) -> DataFrame:
    """Cells after shards above their goals have given to those below: documents without links first.

    The first pass takes documents by hash, later ones the smallest first, so that what is
    left over is less than a small document. Linked documents go only where no others are left,
    those of groups that no shard can hold before those of others.
    """
    cells = scratch.keep(cells, "even-0")
    for turn in range(passes):
        loads = [v + (g if g != goals[-1] else 0) for v, g in zip(loads_of(cells, shards), goals)]
        streams = surplus_flows(loads, goals)
        if max(abs(v - g) for v, g in zip(loads, goals)) <= EVEN * goals[-1] or not streams:
            break
        for_all = F.sum("n").over(Window.partitionBy(*GROUP))
        draw = F.pmod(F.xxhash64(*GROUP, F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        to = F.lit(None).cast("int")
        for i in range(shards):
            out = [(j, v) for (a, j), v in streams.items() if a == i]
            total, upto, goal = sum(v for _, v in out), 0.0, None
            for j, v in out:
                upto += v / total
                goal = F.when(draw < upto, j) if goal is None else goal.when(draw < upto, j)
            if out:
                to = F.when(F.col("shard") == i, goal.otherwise(out[-1][0])).otherwise(to)
        small_first = -F.floor(F.log2(F.col("size"))).cast("int") if turn else F.lit(0)
        urge = F.when(for_all == 1, small_first).when(for_all * F.col("size") > goals[-1], F.lit(-500)).otherwise(F.lit(-1000))
        wish = cells.withColumn("to", to.cast("int")).withColumn("urge", urge)
        cells = scratch.keep(moved(wish, streams, shards), f"even-{turn + 1}")
        scratch.drop(f"even-{turn}")
    return cells


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, turns: int = TURNS, passes: int = PASSES) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, neighbours, together.

    size is the UTF-8 bytes of the text plus 1; a null text has none, so size 1 and crc 0 like
    an empty one. Documents of equal texts are linked (equal in a 64-bit hash, crc and size).
    The law is `bytes`: the sums of sizes of the shards are near equal, so grown_shard is null.
    slot counts the rows of a shard from 0 without gaps, equal texts side by side. neighbours
    counts the linked documents, together those of them in the same shard. Null ids give null
    ids; repeated rows are linked documents of their own; an empty table has no rows. Other
    columns are not read.

    Documents start in a shard by hash. The documents of one group in one shard are
    interchangeable, so each turn moves cells (group, shard, count): a group of any size is at
    most `shards` rows, and its documents are dealt to its cells at the end by their rank.
    Linked documents move under the quota that a shard holds no more linked bytes than an even
    share; then documents without links even the shards out. A group above an even share has
    to be cut and does not propagate, a document above one has a shard of its own. Tables of shards x shards sums are all that the driver sees.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        row_ids(F.col(id_col), F.col(text_col)).alias("oid"),
        F.xxhash64(text).alias("h"),
        F.crc32(text.cast("binary")).alias("crc"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
    )
    rows = scratch.keep(rows, "rows")
    placed = scratch.keep(ranked(scratch, rows, [F.col(c) for c in (*GROUP, "oid")], "ranges"), "placed")
    scratch.drop("rows", "ranges")

    start = placed.groupBy(*GROUP, F.pmod(F.xxhash64("oid"), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    start = scratch.keep(start.withColumn("all", F.sum("n").over(Window.partitionBy(*GROUP))), "start")
    held, goals = pinned(start, shards)
    alone = docs.sparkSession.createDataFrame(held, "h long, crc long, size long, shard int, n long")
    start = start.join(F.broadcast(alone.select(*GROUP).distinct()), list(GROUP), "left_anti")
    fits = (F.col("all") > 1) & (F.col("all") * F.col("size") <= goals[-1])
    linked = propagate(start.where(fits).drop("all"), goals, shards, turns, scratch)
    cells = evened(linked.unionByName(start.where(~fits).drop("all")), goals, shards, passes, scratch).unionByName(alone)

    # A group's rows lie in one or more ranges; rows meet their group's cells by range and group, so never more than a range at once.
    cuts = cells.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("held"))
    firsts = placed.groupBy(*GROUP).agg(F.min("place").alias("first"))
    spans = placed.groupBy("part", *GROUP).agg(F.lit(1).alias("_")).drop("_").join(firsts, list(GROUP)).join(cuts, list(GROUP))
    ends = F.transform("held", lambda c, k: F.struct(F.aggregate(F.slice("held", F.lit(1), k + 1), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("upto"), c["shard"].alias("shard"), c["n"].alias("n")))
    spans = spans.select("part", *GROUP, "first", ends.alias("held"))
    at = F.col("place") - F.col("first")
    cell = F.filter("held", lambda c: c["upto"] > at)[0]
    dealt = placed.join(spans, ["part", *GROUP]).select("part", "place", "oid", "crc", "size", F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("all"), cell.alias("cell"))
    dealt = scratch.keep(dealt.select("part", "place", "oid", "crc", "size", "all", F.col("cell.shard").alias("shard"), F.col("cell.n").alias("n")), "dealt")

    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part", "shard").agg(F.count("*").alias("_n")).select("part", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("part", "shard").orderBy("place")
    slotted = dealt.withColumn("_nth", F.row_number().over(within)).join(starts, ["part", "shard"])
    return slotted.select(
        real_id(F.col("oid")).alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_start") + F.col("_nth") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        (F.col("all") - 1).alias("neighbours"),
        (F.col("n") - 1).alias("together"),
    )
