"""The pipeline against a brute-force version over the smallest documents table."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from spreadlab.llm import mixing, packing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def good(text):
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    repeat = len({j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)})
    lines = [x for x in text.split("\n") if WORD.search(x)]
    stop = {*quality.STOP_WORDS, *(x.capitalize() for x in quality.STOP_WORDS)}
    n, chars = len(w), sum(map(len, w))
    symbols, stops = len(re.findall(r"[#*$%&|<>]", text)), sum(x.rstrip(".,;:") in stop for x in w)
    if n < 50 or 2 * repeat > n:
        return False
    return 2 * n <= chars <= 20 * n and 10 * symbols <= n and 50 * stops >= n and 2 * (len(lines) - len(set(lines))) <= len(lines)


def one_of_equals(docs):
    groups = defaultdict(list)
    for i, t, s in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i, t, s))
    return [min(g)[1:] for g in groups.values()]


def one_of_similar(docs):
    sets = []
    for i, t, s in sorted(docs):
        w = WORD.findall(t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append((i, t, s, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}))
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            common = len(sets[a][3] & sets[b][3])
            if 5 * common >= 4 * len(sets[a][3] | sets[b][3]) and group[a] != group[b]:
                old, new = sorted((group[a], group[b]), reverse=True)
                group = [new if g == old else g for g in group]
    return [x[:3] for k, x in enumerate(sets) if group[k] == k]


def mixed(docs):
    size = {i: len(WORD.findall(t)) for i, t, _ in docs}
    sources = defaultdict(int)
    for i, _, s in docs:
        sources[s] += size[i]
    order = sorted(sources)
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    total, full = sum(sources.values()), set()
    while True:
        level = (total - sum(3 * sources[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and level * weight[s] > 3 * sources[s]}
        if not over:
            break
        full |= over
    out = Counter()
    digest = lambda *p: hashlib.md5("|".join((mixing.SEED, *p)).encode()).hexdigest()
    for s in order:
        rate = min(level * weight[s], 3 * sources[s]) / sources[s] if s not in full else 3.0
        offset = int(digest("offset", s)[:8], 16) / 2**32
        bits = lambda n: max(1, n.bit_length())
        mine = sorted((i for i, _, x in docs if x == s), key=lambda i: (bits(size[i]) * 16 + (size[i] >> max(bits(size[i]) - 4, 0)), digest(str(i)), size[i], i))
        for r, i in enumerate(mine, 1):
            out[i] = int(r * rate + offset) - int((r - 1) * rate + offset)
    return +out, size


def test_pipeline_by_brute_force(spark, small_dir):
    docs = [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    kept = one_of_similar(one_of_equals([d for d in docs if good(d[1])]))
    copies, size = mixed(kept)
    out = corpus_pipeline.run(spark, small_dir).collect()
    words, bins = Counter(), defaultdict(list)
    for r in out:
        words[r.doc_id] += r.n_words
        bins[r.bin].append(r)
    assert words == Counter({i: n * size[i] for i, n in copies.items()})
    assert Counter(r.doc_id for r in out if r.piece == 0) == copies
    for content in bins.values():
        assert sum(r.n_words for r in content) <= packing.CAPACITY and len({r.doc_id for r in content}) == len(content)


def test_stages_return_the_columns_of_documents(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small_dir).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small_dir).count() == 0


def test_near_copies_share_four_fifths_of_five_word_shingles(spark):
    """Two scattered edits in 94 words leave 80 of 100 shingles of five words, and 83 of 99 of four, under 0.85."""
    docs, want = [], set()
    for k, n in enumerate((93, 94, 100)):
        for base, edits in ((100 * k, 0), (100 * k + 1, 2)):
            w = [f"{'abc'[k]}{j}" for j in range(n)]
            for e in range(edits):
                w[20 + 40 * e] = f"edit{e}"
            docs.append((base, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in docs}
    for i, _ in docs:
        if not i % 100 or 5 * len(sets[i] & sets[i - 1]) < 4 * len(sets[i] | sets[i - 1]):
            want.add(i)
    assert want == {0, 1, 100, 200}
    out = corpus_pipeline.ngram_jaccard(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r.doc_id for r in out.collect()} == want
