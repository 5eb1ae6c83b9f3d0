"""Importance resampling against plain counting with zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spreadlab.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(FOLD))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def expected(rows, target):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(bucket, features(x)))
    for x in target:
        t.update(map(bucket, features(x)))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for i, x in rows:
        f = features(x)
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(WORD.findall((x or "").translate(FOLD)))))
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter()
    ranks = []
    for k, r in enumerate(fit[: 25 * len(fit) // 100], 1):
        drawn[r[:4]] += 1
        ranks.append((*r[:4], k))
    rest = Counter(r[:4] for r in out) - drawn
    return sorted([*ranks, *[(*r, None) for r in rest.elements()]], key=str)


def drawn(spark, docs, target):
    got = resample.resample(docs, spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string"))
    return sorted([(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()], key=str)


TARGET = ["w1 w2 w3 again again", "É w9 W10, w11", None, ""]


def test_brute_force(spark, docs, rows):
    odd = [(200, "A-b_C9 ßé ÀÉ a\x00b \x7fz zz" * 9), (201, "x" * 70_000 + " tail " * 30), (202, "a" * 49 + " " + "b" * 48), (202, "same id other text " * 9)]
    plain = [(r[0], r[1]) for r in rows] + odd
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    assert drawn(spark, more, TARGET) == expected(plain, TARGET)


def test_small_head_and_summary_give_the_same(spark, docs, rows, monkeypatch):
    plain = [(r[0], r[1]) for r in rows]
    for name, value in (("HEAD_WORDS", 3), ("HEAD_PAIRS", 2), ("SUMMARY", 8)):
        monkeypatch.setattr(resample, name, value)
    assert drawn(spark, docs, TARGET) == expected(plain, TARGET)


def test_empty_tables_and_columns_of_other_names(spark, empty, docs, rows):
    assert drawn(spark, empty, TARGET) == []
    assert drawn(spark, docs, []) == expected([(r[0], r[1]) for r in rows], [])


@pytest.mark.parametrize("seed", range(3))
def test_slots_that_clash_leave_the_rest_to_the_tail(seed, monkeypatch):
    monkeypatch.setattr(resample, "SLOT_BITS", 4)
    monkeypatch.setattr(resample, "PAIR_BITS", 4)
    rng = random.Random(seed)
    vocabulary = [f"{'é' * rng.randrange(3)}w{k}" for k in range(60)]
    text = " ".join(rng.choice(vocabulary) for _ in range(500))
    raw = np.frombuffer(text.encode(), np.uint8)
    spans = resample.Spans(raw, np.array([0, len(raw)]))
    words = np.unique(spans.key[spans.key > 0])
    pairs = np.unique(np.stack([spans.key[:-1], spans.key[1:]], axis=1), axis=0)
    found = resample.Head(words, pairs, 10_000).features(spans)
    w = text.split()
    assert found[0].tolist() == [bucket(x) for x in w]
    assert found[2].tolist() == [bucket(f"{a} {b}") for a, b in zip(w, w[1:])]
