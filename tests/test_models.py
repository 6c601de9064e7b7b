import itertools
import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from riskloom.config import DetectorSettings, ForestSettings, HOLDOUT_FOREST
from riskloom.operators import envelope, explain, isolation, supervised
from riskloom.sources import stores

NAMES = ["f0", "f1", "f2"]
D = date(2024, 1, 1)
SMALL = ForestSettings(trees=12, depth=4, min_leaf=5)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    x[:12] += 7
    label = (x[:, 0] + 0.5 * x[:, 1] > 1.2).astype(int)
    data = [(f"u{i % 40}", D + timedelta(days=i // 40), *map(float, x[i]), int(label[i])) for i in range(600)]
    return spark.createDataFrame(
        data, "user string, day date, f0 double, f1 double, f2 double, insider_label int"
    ).repartition(4).cache()


@pytest.fixture(scope="module")
def forest(table):
    return supervised.fit_forest(table, NAMES, SMALL)


def test_forest_orders_the_classes(table, forest):
    scored = supervised.with_forest_score(table, forest)
    assert supervised.roc_auc(scored).first()[0] > 0.9
    assert supervised.feature_importances(table, forest).first()["feature"] == "f0"


def test_saved_forest_scores_alike(spark, table, forest, tmp_path):
    stores.save_forest(forest, str(tmp_path / "m"))
    loaded = stores.load_forest(str(tmp_path / "m"))
    a = supervised.with_forest_score(table, forest).orderBy("user", "day").toPandas()
    b = supervised.score_without_labels(table, loaded).orderBy("user", "day").toPandas()
    assert np.allclose(a.supervised_score, b.supervised_score)
    assert set(b.insider_label) == {0}


def test_attributions_add_up_and_match_the_definition(table, forest):
    scored = supervised.with_forest_score(table, forest).limit(6).select("user", "day", "supervised_score", *NAMES)
    raw = scored.orderBy("user", "day").toPandas()
    got = explain.with_attributions(scored, forest).orderBy("user", "day").toPandas()
    assert np.allclose(got[NAMES].sum(axis=1) + got.base_score, raw.supervised_score)
    nodes = explain.forest_nodes(table, forest).toPandas()
    trees = [t.set_index("node").to_dict("index") for _, t in nodes.groupby("tree")]

    def expected(tree, row, known, at=0):
        node = tree[at]
        if node["left"] < 0:
            return node["value"]
        name = NAMES[int(node["feature"])]
        if name in known:
            side = node["left"] if row[name] <= node["threshold"] else node["right"]
            return expected(tree, row, known, side)
        return sum(tree[c]["cover"] / node["cover"] * expected(tree, row, known, c) for c in (node["left"], node["right"]))

    for (_, row), (_, mine) in zip(raw.iterrows(), got.iterrows()):
        for name in NAMES:
            others = [n for n in NAMES if n != name]
            total = 0.0
            for size in range(3):
                weight = math.factorial(size) * math.factorial(2 - size) / 6
                for chosen in itertools.combinations(others, size):
                    total += weight * np.mean([
                        expected(t, row, {*chosen, name}) - expected(t, row, set(chosen)) for t in trees
                    ])
            assert mine[name] == pytest.approx(total, abs=1e-9)


def test_top_features_are_by_size(spark):
    table = spark.createDataFrame([("a", 0.1, -0.5, 0.2)], "user string, f0 double, f1 double, f2 double")
    got = explain.top_features(table, NAMES, 2).orderBy("feature_rank").collect()
    assert [(r["feature_rank"], r["feature"], r["direction"]) for r in got] == [(1, "f1", "down"), (2, "f2", "up")]


ISO = DetectorSettings(isolation_trees=40, isolation_sample=64)


def test_isolation_finds_planted_rows_and_repeats(spark, table, tmp_path):
    model, scored = isolation.fit_isolation(table, NAMES, settings=ISO)
    frame = scored.orderBy("iso_score").toPandas()
    raw = frame.iso_score + model.offset
    assert ((raw > -1) & (raw < 0)).all()
    assert (frame.head(12).f0 > 3).sum() >= 11
    assert abs((frame.iso_prediction == -1).sum() - 12) <= 1
    again, _ = isolation.fit_isolation(table.coalesce(1), NAMES, settings=ISO)
    assert again.offset == pytest.approx(model.offset)
    stores.save_isolation(model, str(tmp_path / "iso"))
    loaded = stores.load_isolation(spark, str(tmp_path / "iso"))
    assert np.allclose(loaded.transform(table).orderBy("iso_score").toPandas().iso_score, frame.iso_score)


def test_sample_is_bounded(table):
    drawn = isolation.keyed_samples(table, NAMES, ["user", "day"], 600, ISO).groupBy("tree").count().collect()
    assert len(drawn) == 40 and max(r["count"] for r in drawn) <= 64 and min(r["count"] for r in drawn) >= 40


def test_normaliser_of_256():
    assert float(isolation.mean_depth(256)) == pytest.approx(10.2448, abs=1e-3)


def test_chi_square_quantiles():
    for p, d, value in ((0.5, 1, 0.4549364), (0.975, 3, 9.3484036), (0.5, 11, 10.3409981)):
        assert envelope.chi2_quantile(p, d) == pytest.approx(value, rel=1e-6)


def test_envelope_does_not_depend_on_the_layout(spark):
    row = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    wide = spark.range(210_000).select(row.alias("a"), (row * row + F.rand(1) * 0).alias("b"))
    one, many = (
        envelope.fit_envelope(wide.repartition(parts, "a"), ["a", "b"]) for parts in (1, 8)
    )
    assert np.allclose(one.mean, many.mean, atol=1e-9) and np.allclose(one.precision, many.precision, rtol=1e-6)
    assert one.offset == pytest.approx(many.offset, rel=1e-6)


def test_pattern_values_add_up_over_sets():
    rng = np.random.default_rng(0)
    values, shares = rng.random(4), rng.random((4, 3))
    got = explain._pattern_values(values, shares)
    for leaf in range(4):
        for pattern in range(8):
            met = [(pattern >> i) & 1 for i in range(3)]
            for i in range(3):
                total = 0.0
                for order in itertools.permutations(range(3)):
                    known = set(order[:order.index(i)])
                    worth = [
                        values[leaf] * np.prod([met[j] if j in chosen else shares[leaf, j] for j in range(3)])
                        for chosen in (known, known | {i})
                    ]
                    total += (worth[1] - worth[0]) / 6
                assert got[leaf, pattern, i] == pytest.approx(total)


def test_envelope_ignores_contamination(spark, tmp_path):
    rng = np.random.default_rng(3)
    true = np.array([[1.0, 0.6], [0.6, 2.0]])
    x = rng.multivariate_normal([1.0, -2.0], true, size=3000)
    x[:150] = rng.normal(30, 1, size=(150, 2))
    data = [(f"u{i}", float(a), float(b), 5.0) for i, (a, b) in enumerate(x)]
    table = spark.createDataFrame(data, "user string, a double, b double, same double")
    model = envelope.fit_envelope(table, ["a", "b", "same"])
    centre = model.mean * np.array(model.scaler.scale) + np.array(model.scaler.mean)
    assert np.allclose(centre[:2], [1.0, -2.0], atol=0.1)
    scale = np.array(model.scaler.scale)[:2]
    covariance = np.linalg.inv(model.precision[:2, :2]) * np.outer(scale, scale)
    assert np.allclose(covariance, true, rtol=0.15, atol=0.1)
    scored = model.transform(table)
    assert scored.where("lof_prediction = -1").count() == 60
    assert scored.where("lof_prediction = -1 and a < 20").count() == 0
    stores.save_envelope(spark, model, str(tmp_path / "e"))
    loaded = stores.load_envelope(spark, str(tmp_path / "e"))
    assert loaded.transform(table).agg(F.sum("lof_score")).first()[0] == pytest.approx(scored.agg(F.sum("lof_score")).first()[0])


def test_scaler_keeps_constants(spark):
    table = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaler = envelope.fit_scaler(table, ["a", "b"])
    assert scaler.mean == [2.0, 5.0] and scaler.scale == [1.0, 1.0]


def test_evaluation_loops(table):
    runs = supervised.holdout_runs(table, NAMES, seeds=[0, 1], settings=SMALL)
    got = {r["metric"]: r for r in supervised.mean_and_spread(runs, ["roc_auc", "precision_at_k"]).collect()}
    assert got["roc_auc"]["runs"] == 2 and got["roc_auc"]["mean"] > 0.8
    folds = supervised.cross_validation_runs(table, NAMES, 2, SMALL).collect()
    assert [r["fold"] for r in sorted(folds)] == [0, 1] and all(r["roc_auc"] > 0.8 for r in folds)


def plain_tree(rows, depth):
    """Best weighted Gini splits by trying all; gives the score of a row and the share of each feature in the gain.

    Leaves of one parent that name the same class are one leaf.
    """
    def gini(part):
        w = sum(x[2] for x in part)
        p = sum(x[2] for x in part if x[1]) / w
        return 1 - p * p - (1 - p) * (1 - p)

    def grow(part, left):
        w = sum(x[2] for x in part)
        leaf = {"share": sum(x[2] for x in part if x[1]) / w}
        best = None
        for f in range(len(part[0][0])) if left else ():
            values = sorted({x[0][f] for x in part})
            for a, b in zip(values, values[1:]):
                cut = (a + b) / 2
                sides = [x for x in part if x[0][f] <= cut], [x for x in part if x[0][f] > cut]
                gain = gini(part) - sum(sum(x[2] for x in s) / w * gini(s) for s in sides)
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                    best = gain, f, cut, sides
        if best is None:
            return leaf
        kids = [grow(s, left - 1) for s in best[3]]
        if all("share" in k for k in kids) and len({k["share"] > 0.5 for k in kids}) == 1:
            return leaf
        return {"feature": best[1], "cut": best[2], "kids": kids, "gain": best[0] * w}

    def score(node, row):
        while "share" not in node:
            node = node["kids"][int(row[node["feature"]] > node["cut"])]
        return node["share"]

    gains = {}

    def gather(node):
        if "share" not in node:
            gains[node["feature"]] = gains.get(node["feature"], 0.0) + node["gain"]
            for k in node["kids"]:
                gather(k)

    top = grow(rows, depth)
    gather(top)
    return lambda row: score(top, row), {f: g / sum(gains.values()) for f, g in gains.items()}


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_a_small_tree_has_the_scores_and_importances_worked_out_by_hand(spark, depth):
    rng = np.random.default_rng(depth)
    x = rng.integers(0, 6, size=(300, 3)).astype(float)
    y = ((x[:, 1] > 3) & (x[:, 0] < 4) | (rng.random(300) < 0.05)).astype(int)
    data = [(f"u{i}", D, *map(float, x[i]), int(y[i])) for i in range(300)]
    table = spark.createDataFrame(data, "user string, day date, f0 double, f1 double, f2 double, insider_label int").repartition(3)
    model = supervised.fit_forest(table, NAMES, ForestSettings(trees=1, depth=depth, min_leaf=1, bootstrap=False))
    weight = {c: (300 / (2 * (y == c).sum())) ** 2 for c in (0, 1)}
    score, shares = plain_tree([(tuple(r), bool(c), weight[c]) for r, c in zip(x, y)], depth)
    got = {r["user"]: r[supervised.SCORE] for r in supervised.with_forest_score(table, model).collect()}
    assert all(got[f"u{i}"] == pytest.approx(score(x[i]), abs=1e-9) for i in range(300))
    found = {r["feature"]: r["importance"] for r in supervised.feature_importances(table, model).collect()}
    assert all(found[f"f{f}"] == pytest.approx(shares.get(f, 0.0), abs=1e-9) for f in range(3))


def test_a_bounded_fit_keeps_every_insider_day_and_the_balance(table):
    settings = ForestSettings(fit_rows=100)
    whole = supervised.fitting_rows(table, ForestSettings()).collect()
    some = supervised.fitting_rows(table, settings).collect()
    again = supervised.fitting_rows(table.repartition(9), settings).collect()
    insiders = [r for r in whole if r["insider_label"]]
    assert sorted(map(str, some)) == sorted(map(str, again))
    assert sorted(map(str, insiders)) == sorted(str(r) for r in some if r["insider_label"])
    others = [r for r in some if not r["insider_label"]]
    assert len(others) == 100
    assert sum(r["weight"] for r in others) == pytest.approx(sum(r["weight"] for r in whole if not r["insider_label"]))
    model = supervised.fit_forest(table, NAMES, ForestSettings(trees=12, depth=4, min_leaf=5, fit_rows=100))
    assert supervised.roc_auc(supervised.with_forest_score(table, model)).first()[0] > 0.9
    assert supervised.with_forest_score(table, model).count() == table.count()


def test_a_fit_reads_every_day_of_a_table_of_any_size(spark):
    n, insiders = 2_400_000, 60_000
    day = F.date_add(F.lit(D), (F.col("id") % 400).cast("int"))
    label = (F.col("id") % 40 == 0).cast("int").alias("insider_label")
    table = spark.range(n).select(F.col("id").cast("string").alias("user"), day.alias("day"), label)
    weight = {1: (n / (2 * insiders)) ** 2, 0: (n / (2 * (n - insiders))) ** 2}
    for settings in (ForestSettings(), HOLDOUT_FOREST):
        rows = supervised.fitting_rows(table, settings).groupBy("insider_label").agg(
            F.count("user").alias("n"), F.min("weight").alias("least"), F.max("weight").alias("most")
        )
        got = {r["insider_label"]: r for r in rows.collect()}
        assert {c: r["n"] for c, r in got.items()} == {1: insiders, 0: n - insiders}
        assert all(r["least"] == r["most"] == pytest.approx(weight[c]) for c, r in got.items())


def test_a_forest_scores_in_a_session_that_observed_a_table(table):
    seen = Observation("seen")
    table.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 600}
    model = supervised.fit_forest(table, NAMES, SMALL)
    assert supervised.with_forest_score(table, model).where(F.col(supervised.SCORE).between(0, 1)).count() == 600


def test_a_share_makes_rows_likelier_to_be_fitted(table):
    heavy = F.when(F.col("f2") > 0, 20.0).otherwise(1.0)
    rows = supervised.fitting_rows(table, ForestSettings(fit_rows=120), share=heavy).where("insider_label = 0").collect()
    assert len(rows) == 120 and sum(r["f2"] > 0 for r in rows) > 90


def test_isolation_samples_draw_each_row_alike(spark):
    table = spark.range(20_000).select(F.col("id").cast("string").alias("user"), F.lit(D).alias("day"), (F.col("id") % 7).cast("double").alias("x"))
    settings = DetectorSettings(isolation_trees=50, isolation_sample=100)
    drawn = isolation.keyed_samples(table, ["user", "x"], ("user", "day"), 20_000, settings)
    sizes = {r["tree"]: r["count"] for r in drawn.groupBy("tree").count().collect()}
    assert set(sizes) == set(range(50)) and all(60 <= n <= 100 for n in sizes.values())
    picked = drawn.groupBy("user").count().collect()
    assert max(r["count"] for r in picked) <= 6 and len(picked) > 3_000
    few = isolation.keyed_samples(table.limit(30), ["x"], ("user", "day"), 30, settings).groupBy("tree").count().collect()
    assert len(few) == 50 and {r["count"] for r in few} == {30}


def test_tabled_intervals_give_the_patterns_of_every_leaf():
    nodes = pd.DataFrame([
        (0, 0, 1, 2, 0, 0.5, 8.0, 0.4), (0, 1, -1, -1, -1, 0.0, 5.0, 0.1), (0, 2, 3, 4, 1, 2.0, 3.0, 0.9),
        (0, 3, 5, 6, 0, 1.5, 2.0, 0.7), (0, 4, -1, -1, -1, 0.0, 1.0, 1.0), (0, 5, -1, -1, -1, 0.0, 1.0, 0.6), (0, 6, -1, -1, -1, 0.0, 1.0, 0.2),
        (1, 0, -1, -1, -1, 0.0, 8.0, 0.3),
    ], columns=["tree", "node", "left", "right", "feature", "threshold", "cover", "value"])
    tables, base = explain._tables(nodes)
    edges = [-math.inf, 0.4, 0.5, 0.6, 1.5, 1.6, 2.0, 2.1, math.inf, math.nan]
    x = np.array([(a, b, 0.0) for a in edges for b in edges])
    expected = np.zeros(x.shape)
    for table in tables:
        members = [(v, t) for v, t in explain._leaf_paths(nodes) if len(t) == table["values"].shape[2]]
        for leaf, (_, tests) in enumerate(members):
            for i, row in enumerate(x):
                pattern = sum(1 << at for at, (f, (low, high, _)) in enumerate(tests.items()) if low < row[f] <= high)
                for at, f in enumerate(tests):
                    expected[i, f] += table["values"][leaf, pattern, at]
    assert np.allclose(explain._attribute(x, tables), expected)
    assert np.allclose(explain._attribute(x, tables, rows=7), expected)
    walk = {(0.5, 0.4): 0.1, (0.6, 2.0): 0.6, (1.6, 2.0): 0.2, (0.6, 2.1): 1.0}
    for (a, b), value in walk.items():
        at = np.flatnonzero((x[:, 0] == a) & (x[:, 1] == b))[0]
        assert explain._attribute(x, tables)[at].sum() + base == pytest.approx((value + 0.3) / 2)
    assert explain._attribute(x[:0], tables).shape == (0, 3)
    # A row costs no comparison of its own with a leaf's bounds.
    assert all("low" not in table and "high" not in table for table in tables)


def test_the_distance_is_one_function_of_the_features(spark):
    rng = np.random.default_rng(5)
    names = [f"x{i}" for i in range(9)]
    x = rng.normal(size=(50, 9))
    mean, root = rng.normal(size=9), rng.normal(size=(9, 9))
    precision = root @ root.T
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *names])
    placed = rows.withColumn("d", envelope.squared_distance([F.col(n) for n in names], mean, precision))
    # The plan grows with the features, not with their square.
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("*") < 9
    got = np.array([r["d"] for r in placed.orderBy("id").collect()])
    assert np.allclose(got, (((x - mean) @ precision) * (x - mean)).sum(axis=1))
    unit = (x - mean) / np.sqrt(((x - mean) ** 2).sum(axis=1))[:, None]
    assert np.allclose(envelope._directions(rows, names, mean), np.cov(unit.T, bias=True))
    # A row at the mean has no direction.
    assert not envelope._directions(rows.where("id = 0"), names, x[0]).any()


def test_complete_trees_end_where_a_walk_ends():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(400, 4)), 1)
    x[:3, 0], x[3, 1], x[4, 2] = np.nan, np.inf, -np.inf
    names = ["tree", "node", "feature", "threshold", "left", "right", "length"]
    nodes = pd.DataFrame(
        [(t, *n) for t in range(12) for n in isolation._grow(x[rng.choice(np.arange(5, 400), 1 if t == 3 else 30)], t)], columns=names
    )
    expected = np.zeros(len(x))
    for _, tree in nodes.groupby("tree"):
        by_id = tree.set_index("node").to_dict("index")
        for i, row in enumerate(x):
            node = by_id[0]
            while node["feature"] >= 0:
                node = by_id[node["left"] if row[int(node["feature"])] <= node["threshold"] else node["right"]]
            expected[i] += node["length"]
    trees = isolation._complete(nodes)
    assert (isolation._total_length(x, trees) == expected).all()
    assert (isolation._total_length(x, trees, block=7) == expected).all()
    assert isolation._total_length(x[:0], trees).tolist() == []
