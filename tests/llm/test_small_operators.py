import hashlib
import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spreadlab.llm import chat, exact, lines, mixing, packing, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def last_none(x):
    return (x is None, x or 0)


def test_exact_dedup_by_brute_force(docs, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[squeezed(t)].append((-len(t or ""), last_none(i), i))
    got = exact.content_sort(docs, piece_rows=4, hot_rows=4).collect()
    assert len(got) == len(rows)
    assert sum(r.kept for r in got) == len(groups)
    keep = {hashlib.sha256(k.encode()).hexdigest(): (min(g)[2], len(g)) for k, g in groups.items()}
    assert all((r.keep_id, r.group_size) == keep[r.text_sha256] for r in got)
    assert all(r.keep_id == r.doc_id for r in got if r.kept)


def test_exact_dedup_pieces_do_not_change_the_result(docs):
    a = sorted(map(tuple, exact.content_sort(docs, piece_rows=2, hot_rows=2).collect()), key=str)
    b = sorted(map(tuple, exact.content_sort(docs, piece_rows=10_000).collect()), key=str)
    assert a == b


def test_drop_copies_keeps_columns_and_one_row_a_group(docs, rows):
    out = exact.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(squeezed(r.text) for r in out.collect()) == sorted({squeezed(r[1]) for r in rows})


def filled(sizes, weights):
    """Targets by resharing, a round at a time."""
    total, order = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    fixed = {}
    while True:
        left, open_ = total - sum(fixed.values()), [s for s in order if s not in fixed]
        goal = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if goal[s] > 3 * sizes[s]]
        if not over:
            return fixed | goal
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mixing_reaches_targets(docs, rows):
    got = mixing.mix(docs).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for i, t, _, s in rows:
        sizes[s] += len(words(t))
        largest[s] = max(largest[s], len(words(t)))
    want = filled(sizes, mixing.WEIGHTS)
    source = {(r[0], len(words(r[1]))): r[3] for r in rows}
    for r in got:
        s = source[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken in (r.size * int(want[s] / max(sizes[s], 1)), r.size * (int(want[s] / max(sizes[s], 1)) + 1)) and r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_mixing_emits_each_row_as_often_as_taken(docs):
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[(r.doc_id, r.size)] += r.copies
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, len(words(r.text))) for r in out.collect()) == +copies


def test_packing_fills_without_conflicts(docs, rows):
    out = packing.pack(docs, capacity=300, source_slots=2, shard_pieces=40).collect()
    total = Counter()
    texts = defaultdict(set)
    for i, t, _, s in rows:
        texts[i].add((squeezed(t), s))
    bins = defaultdict(list)
    for r in out:
        total[r.doc_id] += r.n_words
        bins[r.bin].append(r)
    want = Counter()
    for i, t, *_ in rows:
        want[i] += len(words(t))
    assert +total == +want and len({(r.doc_id, r.piece) for r in out}) >= len({r[0] for r in rows})
    for content in bins.values():
        content.sort(key=lambda r: (r.bin_offset, r.n_words))
        assert sum(r.n_words for r in content) == content[0].bin_words <= 300
        at = 0
        for r in content:
            assert r.bin_offset == at
            at += r.n_words
        ids = [r.doc_id for r in content if r.n_words]
        assert len(ids) == len(set(ids))
        known = [next(iter(texts[i])) for i in ids if len(texts[i]) == 1]
        assert len({k for k, _ in known}) == len(known)
        assert max(Counter(s for _, s in known).values(), default=0) <= 2


def test_best_fit_takes_the_tightest_compatible_bin():
    placed = packing.best_fit([60, 55, 40, 40, 5], [0, 1, 0, 1, 2], [1, 2, 1, 3, 4], 100, 2)
    assert placed == [(0, 0), (1, 0), (1, 55), (0, 60), (1, 95)]


def tightest(sizes, sources, clusters, capacity, slots):
    """Best fit by looking at every open bin for every piece."""
    bins, placed = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        fits = [(capacity - sum(p[0] for p in b), k) for k, b in enumerate(bins)
                if capacity - sum(p[0] for p in b) >= size and all(p[2] != cluster for p in b) and sum(p[1] == source for p in b) < slots]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append([])
        placed.append((k, sum(p[0] for p in bins[k])))
        bins[k].append((size, source, cluster))
    return placed


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_by_brute_force(seed):
    rng = random.Random(seed)
    n = 300
    sizes = sorted((rng.choice([0, 1, rng.randrange(1, 101), 100]) for _ in range(n)), reverse=True)
    sources, clusters = [rng.randrange(5) for _ in range(n)], [rng.randrange(60) for _ in range(n)]
    for slots in (1, 3):
        assert packing.best_fit(sizes, sources, clusters, 100, slots) == tightest(sizes, sources, clusters, 100, slots)


def test_a_shard_is_packed_in_falling_size_by_brute_force():
    """What a task does with the pieces of its shard, against best fit over all open bins."""
    rng = random.Random(9)
    rows = [(k, 0, 0, rng.choice([0, 5, rng.randrange(1, 201)]), rng.randrange(6), rng.randrange(80), rng.randrange(1 << 40), k, 3) for k in range(250)]
    columns = ["doc_id", "piece", "first_word", "n_words", "source_bit", "cluster_bit", "tie", "row", "shard"]
    out = packing.pack_shard(200, 2)(pd.DataFrame(rows, columns=columns))
    order = sorted(rows, key=lambda r: (-r[3], r[6]))
    want = tightest([r[3] for r in order], [r[4] for r in order], [r[5] for r in order], 200, 2)
    assert list(zip(out["doc_id"], out["bin"], out["bin_offset"])) == [(r[0], f"3-{b}", o) for r, (b, o) in zip(order, want)]
    assert all(out["bin_words"] == out.groupby("bin")["n_words"].transform("sum"))


def test_many_rows_without_an_id_are_dealt_out(spark):
    """A third of all rows has no id and one text, a third no id and texts of its own, a third one id."""
    texts = ["the same words again"] * 700 + [f"words of {k} its own" for k in range(700)] + ["under one id"] * 700
    data = [(5 if t == "under one id" else None, t, "s", "x") for t in texts]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, row string").repartition(5)
    out = packing.pack(df, shard_pieces=100).collect()
    pieces = Counter(r.bin.split("-")[0] for r in out)
    assert len(out) == 2100 and max(pieces.values()) <= 200
    got = exact.content_sort(df, piece_rows=16, hot_rows=64).collect()
    assert sum(r.kept for r in got) == 702 and Counter(r.group_size for r in got) == {700: 1400, 1: 700}
    assert exact.drop_copies(df).count() == 702
    mix = mixing.mix(df).collect()
    assert sum(r.taken for r in mix) == sum(r.size for r in mix) == 700 * 4 + 700 * 5 + 700 * 3
    assert mixing.emit(df).count() == sum(r.copies for r in mix)


def brute_quality(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_measures_by_brute_force(spark, docs, rows):
    extra = [(200, "a b c a b c", "en", "s"), (201, "x\nx\n\n \nx y # | <>", "en", "s"), (202, "a a a", None, None), (203, "a b", None, None)]
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string")
    got = quality.apply_rules(docs.unionByName(more, allowMissingColumns=True)).collect()
    assert len(got) == len(rows) + len(extra)
    for r in got:
        n, chars, symbols, dup, repeat = brute_quality(r._row.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)


def test_quality_keeps_prose_and_its_columns(spark):
    good = " ".join(f"The house{k} of river{k} stands{k} with old{k} trees{k} and it{k} was{k} built{k} for them{k}" for k in range(6))
    bad = " ".join("AB## CD|| EF%%" for _ in range(30))
    df = spark.createDataFrame([(1, good, 7), (2, bad, 8), (3, None, 9)], "doc_id long, text string, kept long")
    out = quality.keep_good(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [1]


CHATS = [
    (1, 0, "user", "hi </s>"), (1, 1, "user", "<|more|>\x1b0 a\x1ba"), (1, 2, "assistant", "[INST] ok [/INST]"), (1, 3, "assistant", ""), (1, 3, "assistant", ""),
    (2, 1, None, None), (2, 0, "assistant", "é<|end|>\n"), (None, 0, "user", "x"), (3, None, "sys<|say|>tem", "<|start|>" * 50), (4, 0, "assistant", "y" * 100_000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, 5, "z") for r in CHATS], "conv_id long, turn long, role string, text string, formatted long, _turns string")
    formatted = chat.format_chats(df)
    want = defaultdict(list)
    for c, t, r, x in sorted(CHATS, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    got = {r.conv_id: r for r in formatted.withColumn("t", chat.read_turns(F.col("formatted"))).collect()}
    assert set(got) == set(want)
    for c, r in got.items():
        assert [(t.role, t.text) for t in r.t] == want[c]
        assert sum(m.n for m in r.mask_runs) == len(r.formatted)
        at, learned = 0, []
        for m in r.mask_runs:
            learned.append(r.formatted[at : at + m.n] if m.on else "")
            at += m.n
        plain = "".join(learned)
        for control, code in zip(chat.CONTROLS, chat.CODES):
            assert control not in plain
            plain = plain.replace(code, control)
        assert plain.replace(chat.ESC + "0", chat.ESC) == "".join(x for role, x in want[c] if role == "assistant")
    for r in chat.read_chats(formatted).collect():
        said = "".join(f"{a}\n{b}\n" for a, b in want[r.conv_id])
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.n_turns == len(want[r.conv_id])
    assert got[1].formatted.count(chat.START) == 2


def test_loss_is_read_under_the_mask(spark):
    df = spark.createDataFrame([(1, 0, "user", "a\U0001f600b"), (1, 1, "assistant", "\U0001f600é</s>\x1b0")], "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(df)
    off = chats.withColumn("mask_runs", F.transform("mask_runs", lambda r: r.withField("on", F.lit(False))))
    late = chats.withColumn("mask_runs", F.transform("mask_runs", lambda r, i: F.when(i == 1, r.withField("on", F.lit(True))).otherwise(r.withField("on", F.lit(False)))))
    for masked, loss in ((chats, "\U0001f600é</s>\x1b0"), (off, ""), (late, "a\U0001f600b")):
        r = chat.read_chats(masked).first()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def brute_lines(rows, run):
    order = sorted({(last_none(i), t or "") for i, t, *_ in rows})
    first, out = {}, {}
    content = {}
    for who, text in order:
        all_lines = text.split("\n")
        at = [k for k, x in enumerate(all_lines) if words(x)]
        content[who, text] = all_lines, at
        for s in range(len(at) - run + 1):
            key = tuple(all_lines[k] for k in at[s : s + run])
            here = (who if not who[0] else (True, hash(text)), s)
            first[key] = min(first.get(key, here), here)
    for (who, text), (all_lines, at) in content.items():
        gone = set()
        for s in range(len(at) - run + 1):
            key = tuple(all_lines[k] for k in at[s : s + run])
            if first[key] < (who if not who[0] else (True, hash(text)), s):
                gone |= set(range(s, s + run))
        lost = {at[g] for g in gone}
        out[who, text] = len(at), len(gone), "\n".join(x for k, x in enumerate(all_lines) if k not in lost)
    return out


@pytest.mark.parametrize("run", [2, 3])
def test_line_dedup_by_brute_force(spark, run):
    a, b, c, d = "one line", "two lines", "three", "four"
    data = [(1, f"{a}\n{b}\n{c}"), (2, f"{b}\n{c}\n{d}\n\n{a}\n{b}"), (3, f"{d}\n{b}\n \n{c}\n{d}\n{a}"), (4, f"{a}\n{a}\n{a}\n{a}\n{a}"), (5, None), (6, ""), (7, "\n\n"), (8, f"{a}\n{b}\n{c}"), (8, f"{a}\n{b}\n{c}"), (None, f"{c}\n{d}\n{a}\n{b}")]
    df = spark.createDataFrame([(*r, "k") for r in data], "doc_id long, text string, key string")
    want = brute_lines(data, run)
    got = lines.drop_repeated_lines(df, run=run).collect()
    texts = Counter()
    assert len(got) == len(data)
    for i, t in data:
        texts[(i, *want[last_none(i), t or ""])] += 1
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in got) == texts


def test_single_lines_go_wherever_they_recur(spark, tmp_path):
    """A lone repeated line and copies of one-line documents, which no run of two lines shows."""
    data = [(1, "alone\nshared line\nafter"), (2, "before\nshared line"), (3, "only one"), (4, "only one"), (5, " \nonly one\n\nshared line\nx\nx"), (6, None), (None, "x\nlast")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_lines(data, 1)
    assert want[last_none(4), "only one"] == (1, 1, "") and want[last_none(2), "before\nshared line"] == (2, 1, "before")
    got = queries.QUERIES["op7_single_line_dedup"](spark, str(tmp_path)).collect()
    digest = lambda n, gone, kept: (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    assert Counter(map(tuple, got)) == Counter((i, *digest(*want[last_none(i), t or ""])) for i, t in data)


def test_empty_tables(empty, spark):
    assert exact.content_sort(empty).count() == 0 and exact.drop_copies(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert quality.keep_good(empty).count() == 0
    assert lines.drop_repeated_lines(empty).count() == 0
    assert chat.read_chats(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
