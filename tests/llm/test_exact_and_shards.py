import hashlib
from collections import defaultdict

import numpy as np
import pytest

from riskloom.llm import exact, shards
from riskloom.llm.spread import hashed_at, running_sums

ROWS = [
    (1, "Alpha beta"), (2, "ALPHA beta"), (3, "alpha betA"), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 30_000),
    (9, "X" * 30_000), (10, "x" * 29_999 + "y"), (11, "same"), (11, "same"), (11, "other"), (None, "none"), (None, "none"),
    (12, "Σ"), (13, "alpha beta "),
]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_groups_equal_brute_force(spark, docs_of):
    got = exact.exact_duplicates(docs_of(ROWS)).collect()
    assert len(got) == len(ROWS)
    groups = defaultdict(list)
    for key, text in ROWS:
        groups[hashlib.sha256(lower(text).encode()).hexdigest()].append(key)
    want = sorted(
        (str(k), d, str(max((x for x in keys if x is not None), default=None)), len(keys)) for d, keys in groups.items() for k in keys
    )
    assert sorted((str(r.doc_id), r.digest, str(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_one_row_of_each_group_stays(docs_of):
    docs = docs_of(ROWS)
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [lower(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({lower(t) for _, t in ROWS})


def test_no_rows(docs_of):
    assert exact.exact_duplicates(docs_of(ROWS).where("false")).count() == 0
    assert exact.drop_exact_duplicates(docs_of(ROWS).where("false")).count() == 0
    assert shards.sharded(docs_of(ROWS).where("false")).count() == 0


def smallest_capacity(sizes, n):
    def enough(c):
        used, fill = 1, 0
        for s in sizes:
            if fill + s > c:
                used, fill = used + 1, 0
            fill += s
        return used <= n

    low, high = max(max(sizes), -(-sum(sizes) // n)), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if enough(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("parts", [3, 40, 1 << 14])
def test_shards_are_minimax(spark, docs_of, parts):
    rng = np.random.default_rng(3)
    rows = [(i, "t%d" % rng.integers(0, 150) * int(rng.integers(1, 40))) for i in range(300)] + [(900 + i, "hot") for i in range(150)]
    rows += [(5000, None), (5001, ""), (5002, None), (7, "again"), (7, "again")]
    docs = docs_of(rows)
    got = shards.sharded(docs, shards=7).collect()
    assert len(got) == len(rows)
    by_shard, slots = defaultdict(int), defaultdict(list)
    for r in got:
        by_shard[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = defaultdict(int)
    for _, t in rows:
        sizes[hashlib.md5((t or "").encode()).digest()] += len((t or "").encode()) + 1
    assert max(by_shard.values()) == smallest_capacity([sizes[g] for g in sorted(sizes)], 7)
    where = {}
    for r in got:
        for key, text in rows:
            if key == r.doc_id and key != 7:
                assert where.setdefault(text or "", r.shard) == r.shard
    order = shards.ordered_groups(shards.grouped(docs))
    cuts = shards.fewest_bytes(order, 7, parts)
    assert max(np.diff(cuts)) == max(by_shard.values())


def test_running_sums_of_a_hot_key(spark):
    from pyspark.sql import functions as F

    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    got = running_sums(df, ["k"], hashed_at("id"), [F.col("id")], {"before": F.lit(1)}, 30_000)
    ranks = sorted(r.before for r in got.where("k = 0").collect())
    assert ranks == list(range(len(ranks)))
