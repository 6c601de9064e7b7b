import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import neighbours, warc


def brute_force(rows, nearest):
    sound = [(k, np.array(v, float)) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for key in sorted({k for k, _ in sound if k % 20 == 0}):
        q = min(tuple(v) for k, v in sound if k == key)
        found = sorted((-float((np.array(q) * v).sum()), k) for k, v in sound if k != key)[:nearest]
        out += [(key, rank + 1, k, -s) for rank, (s, k) in enumerate(found)]
    return out


def test_search_of_one_list_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.standard_normal(6).tolist()) for i in range(150)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(60)]  # ties go to the smaller id
    rows += [(300, None), (320, [0.0] * 6), (340, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (360, [float("nan")] * 6), (380, [float("inf")] * 6), (20, [9.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit("x")).withColumn("key", F.lit(1))
    got = neighbours.nearest_neighbours(df, df.where("vec_id % 20 = 0")).collect()
    want = brute_force(rows, 20)
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == [w[:3] for w in want]
    assert np.allclose([r.score for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))], [w[3] for w in want], atol=1e-12)


def test_few_rows_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None)], "vec_id long, embedding array<float>")
    got = neighbours.nearest_neighbours(df, df.where("vec_id % 20 = 0")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5)]
    assert neighbours.nearest_neighbours(df.where("false"), df).count() == 0
    assert neighbours.nearest_neighbours(df, df.where("false")).count() == 0


def test_each_dimension_is_searched(spark):
    """The queries' commonest dimension is not the table's; no valid vector is left out."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(3 if i % 20 == 0 and i < 400 else 2).tolist()) for i in range(600)] + [(1000, [1.0, 2.0, 3.0]), (1020, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest_neighbours(df, df.where("vec_id % 20 = 0")).collect())
    want = []
    for width in (2, 3):
        want += [w[:3] for w in brute_force([r for r in rows if len(r[1]) == width], 20)]
    assert got == sorted(want) and 1020 not in {q for q, _, _ in got} and 1000 in {q for q, _, _ in got}


@pytest.mark.parametrize("list_rows", [neighbours.LIST_ROWS, 64])
def test_recall_on_the_given_vectors(spark, list_rows):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert df.count() // list_rows >= 7  # several lists
    got = neighbours.nearest_neighbours(df, df.where("vec_id % 100 = 0"), list_rows=list_rows).toPandas()
    table = df.toPandas()
    x, ids = np.stack(table.embedding.to_numpy()).astype(float), table.vec_id.to_numpy()
    recall = []
    for q, found in got.groupby("query_id"):
        score = x @ x[np.flatnonzero(ids == q)[0]]
        score[ids == q] = -np.inf
        recall.append(np.isin(ids[np.argsort(-score)[:20]], found.vec_id).mean())
    assert len(recall) == (ids % 100 == 0).sum() and np.mean(recall) >= 0.9


def test_scan_drops_few_of_the_nearest():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((3000, 65)).astype(np.float32), rng.standard_normal((20, 65)).astype(np.float32)
    found = neighbours.scan_list(x, q, 20)
    hits = []
    for k, near in enumerate(found):
        d = ((x - q[k]) ** 2).sum(1)
        hits.append(np.isin(np.argsort(d)[:20], near).mean())
    assert np.mean(hits) > 0.97


PAGES = [
    (1, "http://b.example.com/x", "p" * 1500), (2, "http://a.example.com/y?q=1", "p" * 1500), (9, "http://b.example.com/z", "p" * 1500),
    (3, None, None), (4, "http://b.example.com/x", ""), (5, "not a url\r\nX: y", "é" * 600), (6, "http://B.example.com/x", "é" * 600),
    (7, "http://c.org", "q" * 999), (8, "http://c.org", "q" * 999), (None, "http://c.org", "p" * 1500), (-5, "http://c.org/é", "r" * 200_000),
    (10, "http://d.org", "s" * 2000), (10, "http://d.org", "s" * 2000), (10, "http://d.org", "t" * 2000), (0, "http://e.org", "t" * 2000),
]


def want_of(pages):
    out = []
    answered = set()
    for page, _, html in pages:
        raw = (html or "").encode()
        same = [p for p, _, h in pages if p is not None and (h or "").encode() == raw]
        last = max(same, default=None)
        revisit = page is not None and len(raw) >= 1000 and len(same) > 1 and (page != last or (page, html) in answered)
        answered.add((page, html))
        out.append((str(page), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", str(last) if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("lines", [1, 2, 256])
def test_archives_round_trip(spark, monkeypatch, lines):
    monkeypatch.setattr(warc, "BLOCK_LINES", lines)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("path", F.lit(1)).withColumn("digest", F.lit("d"))
    archive = warc.write_archive(pages)
    keys = pages.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("capture"))
    got = warc.read_archive(archive, keys).collect()
    found = sorted(((r.page or "None", r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)
    assert found == want_of(PAGES)
    none = spark.createDataFrame([("zz)/\t1",), ("",)], "capture string")
    assert warc.read_archive(archive, none).count() == 0


def test_empty_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archive = warc.write_archive(pages)
    assert archive.files == () and warc.read_archive(archive, pages.selectExpr("url as capture")).count() == 0


def test_hosts_are_reversed(spark):
    df = spark.createDataFrame([("http://Www.Example.com:80/A b?c",), (None,), ("x y",)], "u string")
    assert [r[0] for r in df.select(warc.reversed_host_key(F.col("u"))).collect()] == ["com:80,example,www)/A%20b?c", ")", ")x%20y"]
