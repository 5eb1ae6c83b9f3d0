"""Set similarity join on word n-grams: block-skipped index lists and answers taken over from similar sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.llm.common import Scratch, real_id, row_ids
from spreadlab.llm.components import components
from spreadlab.llm.ranks import most_frequent
from spreadlab.llm.tokens import PLACES, Summary, Words, list_column, mixed, runs

SHINGLE = 4
PERCENT = 85
#: Index lists of more sets than this are long: their sets are dealt out by size before they are compared.
LONG = 64
BLOCK = 8
#: Sets of a long list that are compared in one row.
DEAL = 256
#: Leaders that a set of a mixed list meets before the rest of the list is compared.
TURNS = 2
#: Frequent tokens that come last in the global order; 16 bytes each are broadcast.
HEAVY = 1 << 17
#: Distinct tokens that a task counts at a time; the rarer ones are let go.
SUMMARY = 1 << 18


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, no words none."""
    hashes = words.windows(width)
    out = []
    for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(hashes[a : b - width + 1].view(np.int64)))
        elif b > a:
            whole = np.add.reduce(words.hashes[a:b] * PLACES[: b - a]) + np.uint64(b - a)
            out.append(mixed(np.array([whole], np.uint64)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens over about two bits a token: sets differ in at least as many tokens as bits."""
    bits = max(64, 1 << int(2 * len(tokens) - 1).bit_length())
    at = mixed(tokens.view(np.uint64)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


def least_difference(a: bytes, b: bytes) -> int:
    """Lower bound of the number of tokens that only one of two sets has, from their sketches."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(_ONES[x ^ y].sum())


def frequent_tokens(width: int):
    """(token, n) of a task's tokens that stand in more than one of its sets, the most frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Summary(SUMMARY)
        for batch in batches:
            for _, _, data, bounds in runs(batch.column(0)):
                tokens = np.concatenate(shingle_sets(Words(data, bounds, fold=True), width)).view(np.uint64)
                seen.add(tokens, np.zeros(len(tokens), np.uint64))
        token, _, n = seen.merge()
        top = np.argsort(-n, kind="stable")[:HEAVY]
        top = top[n[top] > 1]
        yield pa.RecordBatch.from_arrays([pa.array(token[top].view(np.int64)), pa.array(n[top].astype(np.int64))], ["token", "n"])

    return run


class Order:
    """The global order of tokens: rare ones by hash, then the frequent ones, the rarer first."""

    def __init__(self, heavy: np.ndarray):
        self.sorted = np.sort(heavy)
        self.place = np.argsort(heavy, kind="stable")
        self.likely = np.zeros(1 << 22, bool)
        self.likely[self.slot(heavy)] = True

    @staticmethod
    def slot(tokens: np.ndarray) -> np.ndarray:
        return (tokens.view(np.uint64) >> np.uint64(42)).astype(np.int64)

    def first(self, tokens: np.ndarray, n: int) -> np.ndarray:
        """The first n of a set's tokens, which stand by hash."""
        maybe = np.flatnonzero(self.likely[self.slot(tokens)])
        if not len(maybe):
            return tokens[:n]
        at = np.minimum(np.searchsorted(self.sorted, tokens[maybe]), len(self.sorted) - 1)
        hit = self.sorted[at] == tokens[maybe]
        rare = np.delete(tokens, maybe[hit])
        if len(rare) >= n:
            return rare[:n]
        return np.concatenate([rare, tokens[maybe[hit]][np.argsort(self.place[at[hit]])]])[:n]


def describe(width: int, percent: int, heavy):
    """Per text: size, signature and sketch of its set, and its first tokens in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(heavy.value)
        for batch in batches:
            sizes, ones, twos, sketches, firsts = [], [], [], [], []
            for _, _, data, bounds in runs(batch.column(2)):
                for tokens in shingle_sets(Words(data, bounds, fold=True), width):
                    n = len(tokens)
                    sizes.append(n)
                    plain = tokens.view(np.uint64)
                    ones.append(int(plain.sum(dtype=np.uint64).view(np.int64)) if n else 0)
                    twos.append(int(mixed(plain + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) if n else 0)
                    sketches.append(sketch(tokens))
                    firsts.append(order.first(tokens, min(n, prefix_length(n, percent))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(sketches, pa.binary()), list_column(firsts, pa.int64())],
                ["oid", "th", "n", "s1", "s2", "sketch", "tokens"],
            )

    return run


def differences(sketches: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """`least_difference` of the pairs (i, j) of sketches, which have lengths of powers of two."""
    sketches = sketches.cast(pa.large_binary())
    _, offsets, data = sketches.buffers()
    offsets = np.frombuffer(offsets, np.int64)[sketches.offset : sketches.offset + len(sketches) + 1]
    data = np.frombuffer(data, np.uint8)
    first, length = offsets[:-1], np.diff(offsets)
    i, j = np.where(length[i] <= length[j], i, j), np.where(length[i] <= length[j], j, i)
    out = np.zeros(len(i), np.int64)
    for short, long in set(zip(length[i].tolist(), length[j].tolist())):
        at = np.flatnonzero((length[i] == short) & (length[j] == long))
        for part in range(0, len(at), step := max(1, (1 << 22) // long)):
            k = at[part : part + step]
            x = data[first[i[k]][:, None] + np.arange(short)]
            y = np.bitwise_xor.reduce(data[first[j[k]][:, None] + np.arange(long)].reshape(len(k), -1, short), axis=1)
            out[k] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def candidates(percent: int, block: int = BLOCK):
    """Pairs of index lists that pass the bounds, from rows with the lists `n`, `node`, `rank`, `side` and, if need be, `sketch`.

    Entries of a list stand by size and position in blocks. A pair of blocks is skipped when
    its extreme sizes or positions cannot give the overlap needed; only blocks that pass are
    opened. Entries of equal side are not compared. Lists with sketches give only pairs whose
    sketches do not rule out the similarity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, rank, side = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in range(4))
            lengths = np.diff(batch.column(0).offsets.to_numpy()) if len(batch) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            order = np.lexsort((rank, n, owner))
            sketches = batch.column(4).flatten() if batch.num_columns > 4 else None
            n, node, rank, side, owner = (v[order].astype(np.int64) for v in (n, node, rank, side, owner))
            place = np.arange(len(n)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            heads = np.flatnonzero(place % block == 0)
            if not len(heads):
                continue
            ends = np.append(heads[1:], len(n))
            least, most, front = n[heads], n[ends - 1], np.minimum.reduceat(rank, heads)
            first, step = np.arange(len(heads)), 0
            found = []
            while len(first):
                other = first + step
                first, other = first[other < len(heads)], other[other < len(heads)]
                near = (owner[heads[first]] == owner[heads[other]]) & (100 * most[first] >= percent * least[other])
                first, other = first[near], other[near]
                need = -(-percent * (least[first] + least[other]) // (100 + percent))
                open_ = np.minimum(most[first] - front[first], most[other] - front[other]) >= need
                for part in range(0, int(open_.sum()), 4096):
                    a, b = first[open_][part : part + 4096], other[open_][part : part + 4096]
                    grid = np.arange(block)
                    i = (heads[a][:, None, None] + grid[:, None] + 0 * grid).ravel()
                    j = (heads[b][:, None, None] + 0 * grid[:, None] + grid).ravel()
                    valid = (i < np.repeat(ends[a], block * block)) & (j < np.repeat(ends[b], block * block)) & (i < j)
                    i, j = i[valid], j[valid]
                    need = -(-percent * (n[i] + n[j]) // (100 + percent))
                    fits = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (np.minimum(n[i] - rank[i], n[j] - rank[j]) >= need)
                    fits &= (node[i] != node[j]) & (side[i] != side[j])
                    if sketches is not None:
                        i, j, need = i[fits], j[fits], need[fits]
                        fits = differences(sketches, order[i], order[j]) <= n[i] + n[j] - 2 * need
                    found.append(np.stack([np.minimum(node[i], node[j])[fits], np.maximum(node[i], node[j])[fits]]))
                step += 1
            pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["x", "y"])

    return run


def sketched(percent: int):
    """Pairs whose sketches do not rule out the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 4))
            most = nx + ny - 2 * -(-percent * (nx + ny) // (100 + percent))
            low = np.array([least_difference(a.as_py(), b.as_py()) for a, b in zip(batch.column(3), batch.column(5))], np.int64)
            keep = pa.array(low <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["x", "y"])

    return run


def verified(width: int, percent: int):
    """Pairs of texts whose sets are similar in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[t for _, _, data, bounds in runs(batch.column(k)) for t in shingle_sets(Words(data, bounds, fold=True), width)] for k in (2, 3)]
            both = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*sides)]
            keep = pa.array([100 * o >= percent * (len(a) + len(b) - o) for a, b, o in zip(*sides, both)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["x", "y"])

    return run


def entry(*more: str) -> Column:
    """A list's entry, with the class as its side."""
    return F.struct("n", "node", "rank", F.col("class").alias("side"), *more)


class Join:
    """Tables that the steps of one join share."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, long: int):
        spark = docs.sparkSession
        self.scratch = Scratch(spark, "jaccard")
        self.width, self.percent, self.long = width, percent, long
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.texts = docs.select(row_ids(F.col(id_col), F.col(text_col)).alias("oid"), F.xxhash64(text).alias("th"), text.alias("text"))
        counts = self.texts.select("text").mapInArrow(frequent_tokens(width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        # At most HEAVY rows come to the driver. Which tokens are last decides the work, not the links.
        counts = self.scratch.keep(counts.where(F.col("n") > long), "frequent")
        heavy = sorted((r["n"], r["token"]) for r in most_frequent(counts, HEAVY).collect())
        order = spark.sparkContext.broadcast(np.array([t for _, t in heavy], np.int64))
        self.base = self.scratch.keep(self.texts.mapInArrow(describe(width, percent, order), "oid long, th long, n int, s1 long, s2 long, sketch binary, tokens array<long>"), "base")
        classes = self.base.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("oid", "th")).alias("one"))
        self.classes = self.scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        ones = self.classes.select("node", "one.oid", "one.th")
        nodes = self.base.select("oid", "th", "n", "sketch", "tokens").join(ones, ["oid", "th"]).dropDuplicates(["oid", "th"])
        self.nodes = self.scratch.keep(nodes, "nodes")

    def texts_of(self, pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
        ids = self.nodes.select("node", "oid", "th").join(ends, "node")
        return self.texts.join(ids, ["oid", "th"]).dropDuplicates(["oid", "th"]).select("node", "text")

    def held(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose sketches do not rule out a link."""
        side = lambda c: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        held = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "nx", "sx", "ny", "sy")
        return self.scratch.keep(held.mapInArrow(sketched(self.percent), "x long, y long"), f"{name}-held")

    def verify(self, held: DataFrame, name: str) -> DataFrame:
        """The written pairs (x, y) whose whole sets are similar."""
        texts = self.scratch.keep(self.texts_of(held), f"{name}-texts")
        text = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
        full = held.join(text("x"), "x").join(text("y"), "y").select("x", "y", "tx", "ty")
        links = self.scratch.keep(full.mapInArrow(verified(self.width, self.percent), "x long, y long"), f"{name}-links")
        self.scratch.drop(f"{name}-held", f"{name}-texts")
        return links

    def lists(self) -> DataFrame:
        """(token, node, n, rank, listed): the index lists of two sets or more over the first tokens of all sets.

        `listed` counts all sets of a list; those whose place leaves no room for a link with
        the smallest set that the list offers are left out.
        """
        rows = self.nodes.select("node", "n", F.posexplode("tokens").alias("rank", "token"))
        counts = rows.groupBy("token").agg(F.count("*").alias("listed"), F.min("n").alias("least")).where("listed > 1")
        size = F.greatest(F.col("least"), F.ceil(F.col("n") * self.percent / 100))
        rows = rows.join(counts, "token").where(F.col("n") - F.col("rank") >= self.need(F.col("n"), size))
        return self.scratch.keep(rows.select("token", "node", "n", "rank", "listed"), "lists")

    def need(self, n: Column, other: Column) -> Column:
        """The overlap that a link of sets of these sizes needs."""
        return F.ceil(F.lit(self.percent) * (n + other) / (100 + self.percent))

    def near(self, n: Column, other: Column, rank: Column, other_rank: Column) -> Column:
        """Whether sizes and places leave room for the overlap that a link needs, if this is the first common token."""
        return (F.least(n, other) * 100 >= F.greatest(n, other) * self.percent) & (F.least(n - rank, other - other_rank) >= self.need(n, other))

    def meet(self, left: DataFrame, turn: int) -> DataFrame:
        """(x, y): for each set y the leader x that most of its lists have, from lists with more than one class.

        The sets of a list that are alike in size are led by the one with the fewest rarer
        tokens before the list's own: of near copies, that with the fewest edits of its own,
        which links to most of the others. Every turn cuts the sizes at other places.
        """
        size = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / self.percent) + turn / TURNS) if self.percent < 100 else F.col("n")
        sized = left.withColumn("size", size)
        lead = F.min_by(F.struct("node", "n", "rank", "class"), F.struct("rank", F.xxhash64("node", F.lit(turn))))
        leads = sized.groupBy("token", "size").agg(lead.alias("lead"))
        led = sized.join(leads, ["token", "size"]).where(F.col("class") != F.col("lead.class"))
        near = self.near(F.col("n"), F.col("lead.n"), F.col("rank"), F.col("lead.rank"))
        met = led.where(near).groupBy(F.col("node").alias("y"), F.col("lead.node").alias("x")).agg(F.count("*").alias("c"))
        return met.groupBy("y").agg(F.max(F.struct("c", "x")).alias("best")).select("best.x", "y")

    def links(self) -> DataFrame:
        """Links between sets that connect the same sets as all links do."""
        scratch = self.scratch
        left, links = self.lists().withColumn("class", F.col("node")), None
        for turn in range(TURNS):
            # A set similar to its leader has the leader's class as its answer; only sets of different classes are left to compare.
            found = self.verify(self.held(self.meet(left, turn), f"star-{turn}"), f"star-{turn}")
            links = found if links is None else links.unionByName(found)
            classes = components(links, scratch, f"turn-{turn}")
            placed = left.drop("class").join(classes, "node", "left").select("token", "node", "n", "rank", "listed", F.coalesce("component", "node").alias("class"))
            several = placed.groupBy("token").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").select("token")
            left = scratch.keep(placed.join(several, "token"), f"left-{turn}")
            if turn:
                scratch.drop(f"left-{turn - 1}")
        short = left.where(F.col("listed") <= self.long).groupBy("token").agg(F.collect_list(entry()).alias("l"))
        links = links.unionByName(self.verify(self.compare(short.select("l"), "short"), "short"))
        long = left.where(F.col("listed") > self.long)
        if long.isEmpty():
            return links
        return links.unionByName(self.verify(self.compare(self.dealt(long), "long"), "long"))

    def dealt(self, long: DataFrame) -> DataFrame:
        """Lists `l` of at most some two DEAL sets in which all pairs of a long list meet that can be links.

        The sets of a list stand in blocks by size. Two blocks are compared only if a set of
        the size and place of the one can reach the overlap with the other's; a set goes only
        to such pairs of blocks, and in parts of DEAL sets.
        """
        step = max(math.log(100 / self.percent) / 4, 0.01)
        block = F.floor(F.log(F.col("n").cast("double")) / step).cast("int")
        sized = long.withColumn("block", block)
        counts = sized.groupBy("token", "block").agg(F.count("*").alias("m"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("rank").alias("front"))
        counts = self.scratch.keep(counts, "blocks")
        other = counts.select("token", F.col("block").alias("other"), F.col("m").alias("m2"), F.col("least").alias("least2"), F.col("most").alias("most2"), F.col("front").alias("front2"))
        # At most nine blocks are within reach of a block.
        reach = counts.withColumn("other", F.explode(F.sequence(F.col("block") - 5, F.col("block") + 5))).join(other, ["token", "other"])
        reach = reach.select("token", "block", "other", F.ceil(F.col("m") / DEAL).cast("int").alias("parts"), F.ceil(F.col("m2") / DEAL).cast("int").alias("parts2"), "least2", "most2", "front2")
        rows = sized.join(reach, ["token", "block"])
        # The most favourable set of the other block: least of its sizes that is near enough, at the block's front.
        size = F.greatest(F.col("least2"), F.ceil(F.col("n") * self.percent / 100))
        need = self.need(F.col("n"), size)
        rows = rows.where((size <= F.col("most2")) & (F.col("n") - F.col("rank") >= need) & (F.col("most2") - F.col("front2") >= need))
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        every = F.transform(F.sequence(F.lit(0), F.col("parts2") - 1), lambda j: j)
        first = F.col("block") <= F.col("other")
        task = F.transform(every, lambda j: F.when(F.col("block") == F.col("other"), F.struct(F.col("block").alias("a"), F.col("other").alias("b"), F.least(own, j).alias("i"), F.greatest(own, j).alias("j"))).otherwise(
            F.struct(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), F.when(first, own).otherwise(j).alias("i"), F.when(first, j).otherwise(own).alias("j"))))
        rows = rows.join(self.nodes.select("node", "sketch"), "node")
        dealt = rows.select("token", "node", "n", "rank", "class", "sketch", F.explode(task).alias("task"))
        return dealt.groupBy("token", "task").agg(F.collect_set(entry("sketch")).alias("l"), F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").select("l")

    def compare(self, lists: DataFrame, name: str) -> DataFrame:
        columns = [F.col(f"l.{c}").cast("array<long>").alias(c) for c in ("n", "node", "rank", "side")]
        if "sketch" in lists.schema["l"].dataType.elementType.names:
            columns.append(F.col("l.sketch").alias("sketch"))
        return self.held(lists.select(*columns).mapInArrow(candidates(self.percent), "x long, y long").distinct(), name)


def leasts(join: Join, links: DataFrame, name: str) -> DataFrame:
    """(s1, s2, n, node, least): the least (oid, th) of every class's component."""
    found = components(links, join.scratch, name)
    classes = join.classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classes.groupBy("component").agg(F.min("one").alias("least"))
    return join.scratch.keep(classes.join(least, "component").select("s1", "s2", "n", "node", "least"), f"{name}-leasts")


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT, long: int = LONG) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Sets of distinct `width`-word shingles with A-Z folded; a shorter text is one shingle, a
    null or empty one has no set and no links. Sets link when 100 * common >= percent * union.
    component_id is the least id reachable by links, the row's own included; rows without an
    id stand for their text, come last and give null. All texts under one id are compared, and
    an id joins what they are linked to. Other columns are not read.

    Equal sets are one node. In a global order of tokens, rare ones by hash before the most
    frequent ones, linked sets share a token among their first `prefix_length`. Each set first
    meets the set that leads most of its lists, the one with the fewest tokens of its own among
    those of about its size; one linked to it takes over its class, and the others meet one more
    leader, so that a group of similar sets costs a comparison or two each, and only members of
    different classes are compared further. Lists are opened by blocks: pairs of blocks whose
    sizes or places cannot give the overlap are skipped, and long lists are dealt out by size
    before that, with the sketches of their sets. Candidates are checked by sketches, then by
    their whole sets. Nothing is capped: every pair
    of sets of different classes that share such a token and can be a link is tested.
    """
    join = Join(docs, id_col, text_col, width, percent, long)
    links = join.links()
    rows = join.base.select("oid", "n", "s1", "s2")
    text = F.struct("n", "s1", "s2")
    many = join.scratch.keep(rows.groupBy("oid").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a < b").select("oid"), "many")
    crowd = rows.join(many, "oid").distinct()
    held = crowd.join(join.classes.select("s1", "s2", "n", "node"), ["s1", "s2", "n"])
    same = held.join(held.groupBy("oid").agg(F.min("node").alias("x")), "oid").select("x", F.col("node").alias("y"))
    classes = leasts(join, links.unionByName(same), "all")
    found = rows.join(classes.select("s1", "s2", "n", F.col("least.oid").alias("least")), ["s1", "s2", "n"], "left")
    # An id on a text without words has no node there and goes with its other texts.
    of_id = held.join(classes.select("node", F.col("least.oid").alias("of_id")), "node").groupBy("oid").agg(F.min("of_id").alias("of_id"))
    found = found.join(of_id, "oid", "left")
    return found.select(
        real_id(F.col("oid")).alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        real_id(F.least(F.coalesce("least", "of_id", "oid"), F.col("oid"))).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT, long: int = LONG) -> DataFrame:
    """One row of docs for each component of texts, with its own columns: that of its least id, then of the least hash of its text.

    Of rows that agree in id and text one stays. Texts without shingles stay, one a text and
    id. Texts that differ under one id stay or go on their own. Components are those of
    `similar_sets`, but for its joining of texts by their id.
    """
    join = Join(docs, id_col, text_col, width, percent, long)
    ones = leasts(join, join.links(), "all").select("least.oid", "least.th").distinct()
    ones = ones.unionByName(join.base.where("n = 0").select("oid", "th").distinct())
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("_row"), row_ids(F.col(id_col), F.col(text_col)).alias("oid"), F.xxhash64(text).alias("th"))
    one = F.row_number().over(Window.partitionBy("oid", "th").orderBy(F.xxhash64("_row")))
    return rows.join(ones, ["oid", "th"], "left_semi").withColumn("_one", one).where("_one = 1").select("_row.*")
