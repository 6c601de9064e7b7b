import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from riskloom.llm import quality
from riskloom.llm.tokens import token_ids

SF = "/root/testdata/sf0.01"
WORDS = re.compile("[a-z0-9\x80-\U0010ffff]+")


def shingle_set(text):
    words = WORDS.findall(text.lower())
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage of one run."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    seen.append(docs.collect())
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == names
        docs = corpus_pipeline.stored(out, "pipeline-test")
        seen.append(docs.collect())
    return seen


def test_quality_keeps_what_the_model_accepts(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.quality_scores(docs, model).where("score >= 0.3").collect()}
    assert {r.doc_id for r in stages[1]} == good and len(good) < len(stages[0])


def test_exact_copies_go(stages):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    last = {}
    for r in stages[1]:
        key = lower(r.text)
        last[key] = max(last.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in stages[2]) == sorted(last.values())


def test_one_of_each_similar_group_stays(stages):
    sets = {r.doc_id: shingle_set(r.text) for r in stages[2]}
    holders = defaultdict(list)
    for key, s in sets.items():
        for g in s:
            holders[g].append(key)
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, s in sets.items():
        shared = Counter(b for g in s for b in holders[g] if b > a)
        for b, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[b]) - n) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in stages[3]) == sorted({find(k) for k in sets})


def test_mix_follows_the_weights(stages):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    have, got = Counter(), Counter()
    for r in stages[3]:
        have[r.source] += size(r.text)
    for r in stages[4]:
        got[r.source] += size(r.text)
    total, weights = sum(have.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(have))}
    full = set()
    while True:
        rest = total - sum(3 * have[s] for s in full)
        w = sum(weights[s] for s in have if s not in full)
        target = {s: 3 * have[s] if s in full else weights[s] * rest / w for s in have}
        over = {s for s in have if target[s] > 3 * have[s] + 1e-9}
        if not over:
            break
        full |= over
    longest = max(size(r.text) for r in stages[3])
    assert all(abs(got[s] - target[s]) <= longest for s in have)
    assert max(Counter(r.doc_id for r in stages[4]).values()) <= 3


def test_packing_holds_every_token(stages):
    want = sum(len(token_ids(r.text)) + 1 for r in stages[4])
    assert sum(r.length for r in stages[5]) == want
    filled = Counter()
    for r in stages[5]:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024 and len(filled) <= want / 1024 * 1.05 + 1
