import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spreadlab.llm import jaccard, langid, substring, suffix
from spreadlab.llm.components import components
from spreadlab.llm.common import Scratch
from spreadlab.llm.tokens import winnowed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def documents(rows):
    """Distinct documents in order: rows without an id last, one for each text."""
    return sorted({((i is None, i or 0), t or "") for i, t, *_ in rows})


def brute_passages(rows, window):
    first = {}
    docs = documents(rows)
    for who, text in docs:
        w = words(text)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, ((True, 1), 0)), (who, s))
    out = {}
    for who, text in docs:
        w = words(text)
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (who, s):
                gone |= set(range(s, s + window))
        out[who, text] = len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    return out


def test_substring_by_brute_force(docs, rows):
    want = brute_passages(rows, 20)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.drop_passages(docs).collect())
    assert got == Counter((r[0], *want[(r[0] is None, r[0] or 0), r[1] or ""]) for r in rows)
    assert sum(w[1] for w in want.values()) > 1000


def brute_strings(rows, length):
    docs = [(who, text.encode()) for who, text in documents(rows)]
    count = Counter(b[i : i + length] for _, b in docs for i in range(len(b) - length + 1))
    out = {}
    for who, b in docs:
        marks = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                marks[i] += 1
                marks[i + length] -= 1
        gone = np.cumsum(marks[: len(b)]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out[who, b.decode()] = len(b), int(gone.sum()), len(edges) // 2, hashlib.sha256(rest).hexdigest()
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_by_brute_force(docs, rows, hot):
    want = brute_strings(rows, 200)
    found = suffix.drop_repeats(docs, hot_group=hot).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == Counter((r[0], *want[(r[0] is None, r[0] or 0), r[1] or ""]) for r in rows)


def test_suffix_names_order_rows():
    rng = np.random.default_rng(1)
    block = rng.integers(0, 2, (200, 48), dtype=np.uint8)
    order, common = suffix.adjacent(block, np.zeros(200, np.int64))
    ordered = [block[k].tobytes() for k in order]
    assert ordered == sorted(ordered)
    for k in range(1, 200):
        n = next((j for j in range(48) if ordered[k][j] != ordered[k - 1][j]), 48)
        assert common[k] == n


def test_cover_meets_in_equal_strings():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 101, 900, dtype=np.uint8)
    other = np.concatenate([rng.integers(97, 101, 77, dtype=np.uint8), text[300:500], rng.integers(97, 101, 50, dtype=np.uint8)])
    a, b = (set(suffix.sampled(x, 200, 64)[0].tolist()) for x in (text, other))
    assert {p - 300 for p in a if 300 <= p <= 436} & {p - 77 for p in b if 77 <= p <= 213}
    assert len(winnowed(np.zeros(5, np.uint64), 9)) == 0


def shingles(text, width=4):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute_components(rows):
    docs = documents(rows)
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a + 1, len(docs)):
            same = docs[a][0] == docs[b][0] and not docs[a][0][0]
            common = len(sets[a] & sets[b])
            if same or (sets[a] and sets[b] and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common)):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), None if docs[root(k)][0][0] else docs[root(k)][0][1]) for k, (d, s) in enumerate(zip(docs, sets))}


@pytest.mark.parametrize("long", [64, 4])
def test_jaccard_by_brute_force(docs, rows, long):
    want = brute_components(rows)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_sets(docs, long=long).collect())
    assert got == Counter((r[0], *want[(r[0] is None, r[0] or 0), r[1] or ""]) for r in rows)
    assert len({w for w in want.values()}) < len(want) - 20


def test_jaccard_keeps_one_of_each_group(docs, rows):
    out = jaccard.drop_near_copies(docs, long=8)
    want = brute_components(rows)
    stay = {r[0] for r in rows if r[0] is not None and want[(False, r[0]), r[1] or ""][1] == r[0]}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} - {None} == stay


def sets_by_brute_force(spark, rows, **params):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_sets(df, **params).collect())
    want = brute_components(rows)
    assert got == Counter((i, *want[(i is None, i or 0), t or ""]) for i, t in rows)
    return df


def test_jaccard_ids_on_different_texts_null_ids_and_repeats(spark):
    """Links of every text under an id count for the id; texts under one id stay or go on their own."""
    c, d = ([f"{x}{k}" for k in range(50)] for x in "cd")
    text = " ".join
    rows = [(5, text(c)), (5, text(d)), (6, text([*d, "x"])), (7, text([*c, "x"])), (8, None), (8, text(["e"] * 9)), (9, text(["e"] * 9))]
    a, b = text(["a"] * 3 + c[:9]), text(d[30:49])
    rows += [(11, a), (12, b), (12, a), (13, b)]
    base = [f"w{k}" for k in range(40)]
    rows += [(None, text([*base, f"x{k % 7}"])) for k in range(40)] + [(None, None)] * 9 + [(3, text(base))] * 4
    df = sets_by_brute_force(spark, rows, long=3)
    kept = [(5, text(c)), (5, text(d)), (8, None), (8, text(["e"] * 9)), (11, a), (12, b), (3, text(base)), (None, None)]
    assert sorted(map(str, map(tuple, jaccard.drop_near_copies(df, long=3).collect()))) == sorted(map(str, kept))


def test_jaccard_groups_that_share_passages(spark, monkeypatch):
    """Groups of similar texts and texts that only share a passage, in long lists dealt out in small parts."""
    monkeypatch.setattr(jaccard, "HEAVY", 4)
    monkeypatch.setattr(jaccard, "DEAL", 3)
    rng = np.random.default_rng(6)
    shared = [f"s{k}" for k in range(24)]
    rows = []
    for g in range(12):
        base = [f"g{g}v{k}" for k in range(int(rng.integers(1, 60)))] + shared
        for k in range(6):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, 3))):
                w[at] = f"e{g}x{k}x{at}"
            rows.append((len(rows), " ".join(w[: len(w) - int(rng.integers(0, 4))])))
    sets_by_brute_force(spark, rows, long=2)


@pytest.mark.parametrize("centre", [True, False])
def test_jaccard_compares_near_copies_a_few_times_each(spark, monkeypatch, centre):
    """Pairs grow with a group of near copies, not with its square, whether or not the text is there that all others were edited from."""
    pairs, held = [], jaccard.Join.held
    monkeypatch.setattr(jaccard.Join, "held", lambda self, found, name: pairs.append(found.count()) or held(self, found, name))
    rng = np.random.default_rng(8)
    rows = [(0, " ".join(f"v{k}" for k in range(150)))] if centre else []
    for i in range(1, 321):
        w = [f"v{k}" for k in range(150)]
        for at in rng.choice(150, 1 + i % 4, replace=False):
            w[at] = f"e{i}x{at}"
        rows.append((i, " ".join(w)))
    sets_by_brute_force(spark, rows)
    assert sum(pairs) < 8 * len(rows)


def test_differences_of_sketches_of_any_length():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(-(1 << 62), 1 << 62, n)) for n in (3, 40, 41, 70, 150, 0, 300, 64)]
    sets.append(sets[4][:140])
    sketches = [jaccard.sketch(s) for s in sets]
    i, j = (v.ravel() for v in np.indices((len(sets), len(sets))))
    got = jaccard.differences(pa.array([b"x", *sketches], pa.binary())[1:], i, j)
    assert got.tolist() == [jaccard.least_difference(sketches[a], sketches[b]) for a, b in zip(i, j)]


def test_sketch_never_overstates():
    rng = np.random.default_rng(3)
    for n, m in ((5, 7), (100, 90), (500, 30), (64, 2000)):
        a, b = (np.unique(rng.integers(0, 3000, k)) for k in (n, m))
        assert jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 200), (200, 150), (7, 7)]
    out = components(spark.createDataFrame(links, "x long, y long"), Scratch(spark, "test"), "c")
    got = {r.node: r.component for r in out.collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 150: 100}


def test_language_network_learns(spark):
    rng = np.random.default_rng(4)
    parts = {"aa": ["bal", "dor", "mit", "kan"], "bb": ["süß", "ch", "ung", "eit"], "cc": ["ção", "ñ", "os", "ie"]}
    rows = []
    for k in range(600):
        lang = list(parts)[k % 3]
        rows.append((k, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(int(rng.integers(5, 120)))), lang if k % 7 else None, "x", "y"))
    rows += [(700, None, "aa", "x", "y"), (701, "", "aa", "x", "y"), (702, "123 !!", "bb", "x", "y"), (None, "baldor mitkan", None, None, "y"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, _b string")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    truth = {k: list(parts)[k % 3] for k in range(600)}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95
    assert {r.lang_pred for r in got if r.doc_id in (700, 701, 702)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 0}) == 1
    assert sorted(map(str, got)) == sorted(map(str, langid.identify(df).collect()))


def test_network_by_plain_loops(spark):
    """The forward pass, filter by filter and place by place, and the mean over the windows of a text."""
    rng = np.random.default_rng(8)
    network = langid.Network.fresh(["aa", "bb", "cc"])
    for p in network.parameters():
        p += rng.normal(size=p.shape).astype(np.float32) * 0.1
    network.filters *= langid.filter_mask()
    texts = ["short é", "x" * 300 + "yz" * 200, "".join(chr(97 + int(k)) for k in rng.integers(0, 26, 700))]

    def chances(window):
        features = []
        for f in range(network.filters.shape[1]):
            width = langid.WIDTHS[f // langid.FILTERS]
            best = max(
                sum(float(network.embedding[window[at + j]] @ network.filters[j * langid.EMBED : (j + 1) * langid.EMBED, f]) for j in range(width))
                for at in range(langid.WINDOW - max(langid.WIDTHS) + 1)
            )
            features.append(max(best + float(network.biases[f]), 0.0))
        scores = np.exp(np.array(features) @ network.out + network.out_bias)
        return scores / scores.sum()

    want = {}
    for k, text in enumerate(texts):
        data = text.encode()
        starts = [0] if len(data) <= langid.WINDOW else [*range(0, len(data) - langid.WINDOW, langid.WINDOW), len(data) - langid.WINDOW]
        mean = np.mean([chances([*data[s : s + langid.WINDOW], *[256] * (langid.WINDOW - len(data))]) for s in starts], axis=0)
        want[k] = (network.labels[int(mean.argmax())], float(mean.max()))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in langid.predict(df, network).collect():
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-4)


def test_windows_cover_whole_texts():
    bounds = np.array([0, 10, 10, 1000], np.int64)
    owner, start = langid.window_starts(bounds)
    covered = defaultdict(set)
    for o, s in zip(owner.tolist(), start.tolist()):
        covered[o] |= set(range(s, s + langid.WINDOW))
    assert set(range(10)) <= covered[0] and set(range(990)) <= covered[2] and 1 in covered


def test_empty_tables(empty):
    assert substring.drop_passages(empty).count() == 0
    assert suffix.drop_repeats(empty).count() == 0
    assert jaccard.similar_sets(empty).count() == 0 and jaccard.drop_near_copies(empty).count() == 0
    assert langid.identify(empty).count() == 0


def test_words_and_bytes_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in substring.drop_passages(df).orderBy("doc_id").select("n_words", "n_removed").collect()] == [(0, 0), (0, 0)]
    assert suffix.drop_repeats(df).agg(F.sum("n_bytes")).first()[0] == 0
