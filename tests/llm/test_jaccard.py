import re

import numpy as np
import pytest

from riskloom.llm import jaccard
from riskloom.llm.components import components
from riskloom.llm.shingles import minhashes, shingles

WORDS = re.compile("[a-z0-9\x80-\U0010ffff]+")


def shingle_set(text):
    words = WORDS.findall((text or "").lower())
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_force(rows):
    """class, links, linked texts and copies of every key."""
    sets = {}
    for key, text in rows:
        sets.setdefault(shingle_set(text), []).append(key)
    nodes = [s for s in sets if s]
    linked = {s: [o for o in nodes if o is not s and len(s & o) >= 0.8 * len(s | o) - 1e-9] for s in nodes}
    out = []
    for key, text in rows:
        s = shingle_set(text)
        if not s:
            out.append((key, key, 0, 0, 1))
            continue
        seen, todo = {s}, [s]
        while todo:
            for o in linked[todo.pop()]:
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
        out.append((
            key, min(k for o in seen for k in sets[o]), sum(len(sets[o]) for o in linked[s]) + len(sets[s]) - 1,
            len(linked[s]), len(sets[s]),
        ))
    return sorted(out)


def planted():
    rng = np.random.default_rng(4)
    draw = lambda n: [f"w{rng.integers(0, 5000)}" for _ in range(n)]
    rows, key = [], 0
    for size in (3, 6, 40, 200, 400):
        base = draw(size)
        for edits in (0, 0, 1, 1, 2, 4, 9):
            words = list(base)
            for at in rng.integers(0, size, edits):
                words[at] = f"e{rng.integers(0, 10**6)}"
            rows.append((key, " ".join(words)))
            key += 1
    hot = draw(120)
    for k in range(150):  # a large group of near copies, and a passage many share
        words = list(hot)
        words[k % 120] = f"h{k}"
        rows.append((key, " ".join(words)))
        rows.append((key + 1, " ".join(draw(80) + hot[:40])))
        key += 2
    rows += [(9000, None), (9001, ""), (9002, "?!"), (9003, "One, two"), (9004, "one TWO!"), (9005, "ÀB ça"), (9006, "x " * 20_000)]
    return rows


@pytest.mark.parametrize("block, nodes", [(1 << 20, 1 << 11), (1500, 1 << 11), (1 << 20, 16)])
def test_join_equals_brute_force(docs_of, block, nodes):
    rows = planted()
    got = jaccard.similar_documents(docs_of(rows), block_shingles=block, block_nodes=nodes)
    found = sorted((r.doc_id, r.class_id, r.links, r.linked_texts, r.copies) for r in got.collect())
    assert found == brute_force(rows)


def test_one_of_each_class_stays(docs_of):
    rows = planted()
    docs = docs_of(rows)
    kept = jaccard.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, *_ in brute_force(rows)})


def test_repeated_rows_and_no_rows(docs_of):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words of the same key"), (2, "a b c d e f g!")]
    got = jaccard.similar_documents(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.class_id, r.links, r.copies) for r in got) == [(1, 1, 0, 1), (1, 1, 2, 3), (1, 1, 2, 3), (2, 1, 2, 3)]
    assert jaccard.similar_documents(docs_of(rows).where("false")).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    least = jaccard.least_matches()
    rng = np.random.default_rng(0)
    equal = rng.random((20_000, len(least), jaccard.STEP)) < jaccard.THRESHOLD
    kept = (np.cumsum(equal.sum(2), axis=1) >= least).all(1)
    assert kept.mean() > 0.999
    far = rng.random((2000, len(least), jaccard.STEP)) < 0.3
    assert (np.cumsum(far.sum(2), axis=1) >= least).all(1).mean() < 0.01


def test_lost_links_are_as_few_as_stated():
    assert jaccard.lost_share(0.8) < 6e-6 and jaccard.lost_share(0.8) - (1 - 0.8 ** 4) ** 24 < 2e-6
    assert jaccard.lost_share(0.82) < 1e-6 and jaccard.lost_share(0.85) < 4e-8
    assert jaccard.lost_share(0.8, tolerance=1e-5) > 7e-5


def test_a_large_group_of_near_copies_needs_little_memory():
    """Every pair of a job survives: pairs are checked as they come, and no list of them is kept."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    n = 3_000
    base = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[:97], rng.integers(0, 1 << 63, 3).astype(np.uint64)])) for _ in range(n)]
    same = lambda v, kind: pa.array([v] * n, kind)
    rows = pa.record_batch([
        same(0, pa.int32()), same(b"bucket00", pa.binary()), same(0, pa.int64()), same(0, pa.int64()), same(0, pa.int64()),
        pa.array([k.to_bytes(16, "little") for k in range(n)]), pa.array([len(s) for s in sets], pa.int32()),
        pa.array([np.r_[minhashes(base[:97])[:4], minhashes(s)[4:]].astype("<u2").tobytes() for s in sets]), same(1, pa.int64()),
        pa.array([s.astype("<u8").tobytes() for s in sets]),
    ], [*jaccard.JOB, "block", "node", "n", "sketch", "copies", "shingles"])
    tracemalloc.start()
    used = sum(b.num_rows for b in jaccard._candidates(0.8, jaccard.TOLERANCE)(iter([rows])))
    found = pa.Table.from_batches(jaccard._check(0.8, jaccard.TOLERANCE)(iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert used == n and set(found.column("texts").to_pylist()) == {n - 1}
    assert len(set(found.column("root").to_pylist())) == 1 and peak < 60e6


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1600], rng.integers(0, 1 << 64, 400, dtype=np.uint64)])
    assert abs((minhashes(np.unique(a)) == minhashes(np.unique(b))).mean() - 1600 / 2400) < 0.15
    assert len(shingles("a b c")) == 1 and len(shingles(" ?")) == 0 and len(shingles("a b c d e f")) == 2


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1003), (1003, 1001), (7000, 7000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in (1000, 1001, 1003)} == {1000}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
