"""Tree contributions equal brute-force Shapley values of the path-dependent value
function; base + sum(phi) equals the model margin; waterfall semantics."""

import itertools
import math
import tempfile

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave.operators.explain import (
    contributions_numpy, expected_value, leaf_paths, node_rows, split_gains, tree_contributions, waterfall,
)
from riskweave.sources.bundle import gbt_node_table


def _model(spark):
    df = spark.range(300).select(F.col("id").alias("k"), *[F.rand(s).alias(f"f{s}") for s in range(4)])
    df = df.withColumn("y", ((F.col("f0") + 0.5 * F.col("f1") * F.col("f2") + 0.2 * F.rand(9)) > 0.7).cast("double"))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=[f"f{s}" for s in range(4)], outputCol="features"),
                            GBTClassifier(labelCol="y", maxIter=4, maxDepth=3, stepSize=0.3, seed=1)])
    m = pipe.fit(df)
    path = tempfile.mkdtemp(prefix="rw-gbt-")
    m.write().overwrite().save(path)
    nodes = node_rows(gbt_node_table(spark, path, m))
    return df, m, nodes


def test_split_gains_of_a_fitted_model(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("double").alias("y"), ((F.col("id") % 2) + F.rand(1) * 0.5).alias("good"), F.rand(2).alias("noise"))
    m = Pipeline(stages=[VectorAssembler(inputCols=["good", "noise"], outputCol="features"),
                         GBTClassifier(labelCol="y", maxIter=1, maxDepth=2, seed=1)]).fit(df)
    path = tempfile.mkdtemp(prefix="rw-gain-")
    m.write().overwrite().save(path)
    got = {r.feature: r.split_gain for r in split_gains(gbt_node_table(spark, path, m), ["good", "noise"]).collect()}
    # labels -1 / 1 of variance 1 over 400 rows: the first split on the separating feature removes all of it
    assert abs(got["good"] - 400.0) < 1e-6 and got.get("noise", 0.0) < 1e-6


def _brute(x, nodes, weights, p):
    trees = {}
    for n in nodes:
        trees.setdefault(n["treeID"], {})[n["id"]] = n

    def ev(tree, nid, S):
        n = tree[nid]
        if n["left"] < 0:
            return n["prediction"]
        if n["feature"] in S:
            return ev(tree, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"], S)
        lc, rc = tree[n["left"]]["cover"], tree[n["right"]]["cover"]
        return (lc * ev(tree, n["left"], S) + rc * ev(tree, n["right"], S)) / n["cover"]

    def v(S):
        return sum(weights[t] * ev(tree, 0, S) for t, tree in trees.items())

    phi = np.zeros(p)
    for i in range(p):
        others = [j for j in range(p) if j != i]
        for r in range(p):
            for S in itertools.combinations(others, r):
                w = math.factorial(len(S)) * math.factorial(p - len(S) - 1) / math.factorial(p)
                phi[i] += w * (v(set(S) | {i}) - v(set(S)))
    return phi, v(set())


def test_tree_contributions_match_brute_force_and_margin(spark):
    df, m, nodes = _model(spark)
    weights = list(m.stages[-1].treeWeights)
    paths = leaf_paths(nodes, weights)
    X = np.array([[r[f"f{s}"] for s in range(4)] for r in df.orderBy("k").limit(12).collect()])
    phi = contributions_numpy(X, paths, 4)
    base = expected_value(paths)
    for row, ph in zip(X, phi):
        bf, v0 = _brute(row, nodes, weights, 4)
        assert np.allclose(ph, bf, atol=1e-12)
        assert abs(base - v0) < 1e-12
    # distributed version: base + sum(phi) == rawPrediction[1]
    tc = tree_contributions(df, "k", [f"f{s}" for s in range(4)], paths)
    margin = m.transform(df).select("k", vector_to_array("rawPrediction")[1].alias("margin"))
    j = tc.join(margin, "k").select((F.lit(base) + sum(F.col(f"f{s}") for s in range(4)) - F.col("margin")).alias("e"))
    assert j.agg(F.max(F.abs("e"))).first()[0] < 1e-12


def test_waterfall_top_and_running_sum(spark):
    df = spark.createDataFrame([(1, 0.5, -0.2, 0.05, -0.9)], "k int, a double, b double, c double, d double")
    phi = {c: F.col(c) for c in "abcd"}
    plan = waterfall(df, "k", phi, 0.1, top=3)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    wf = {r.feature: r for r in waterfall(df, "k", phi, 0.1, top=3).collect()}
    assert set(wf) == {"a", "b", "d"}  # c has the smallest |phi|
    assert [wf[f].step for f in ("b", "a", "d")] == [1, 2, 3]
    assert abs(wf["d"].end - (0.1 - 0.2 + 0.5 - 0.9)) < 1e-12
    assert abs(wf["a"].start - (0.1 - 0.2)) < 1e-12 and wf["d"].direction == "decrease"


def test_waterfall_other_row_reaches_full_margin(spark):
    df = spark.createDataFrame([(1, 0.5, -0.2, 0.05, -0.9, 0.01)], "k int, a double, b double, c double, d double, e double")
    wf = sorted(waterfall(df, "k", {c: F.col(c) for c in "abcde"}, 0.1, top=3, other=True).collect(), key=lambda r: r.step)
    assert wf[0].feature == "other" and abs(wf[0].phi - 0.06) < 1e-12
    assert abs(wf[-1].end - (0.1 + 0.5 - 0.2 + 0.05 - 0.9 + 0.01)) < 1e-12


def _forest(rng, trees, depth, p):
    """Random node tables whose trees have 2 ** depth leaves."""
    nodes = []
    for t in range(trees):
        ids = itertools.count()

        def grow(level, cover):
            node = {"treeID": t, "id": next(ids), "prediction": float(rng.normal()), "cover": cover, "left": -1, "right": -1,
                    "feature": -1, "threshold": None}
            nodes.append(node)
            if level < depth:
                part = cover * float(rng.choice([0.0, 0.25, 0.5, 0.9]))
                node |= {"feature": int(rng.integers(p)), "threshold": float(rng.choice([-0.5, 0.0, 0.5])),
                         "left": grow(level + 1, part), "right": grow(level + 1, cover - part)}
            return node["id"]

        grow(0, 128.0)
    return nodes


def test_deep_trees_match_brute_force_for_few_and_many_rows():
    """Repeated features on a path, empty nodes (cover 0), values on thresholds, missing values; fewer and
    more rows than a path has codes."""
    rng = np.random.default_rng(3)
    nodes, weights, p = _forest(rng, 3, 7, 5), [1.0, 0.5, -0.25], 5
    assert any(n["cover"] == 0 for n in nodes)  # a node without rows has no shares
    paths = leaf_paths(nodes, weights)
    assert len(paths) == 3 * 128
    X = rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 2.0, np.nan], (600, p))
    phi = contributions_numpy(X, paths, p)
    for few in (1, 5, 100):
        assert np.allclose(contributions_numpy(X[:few], paths, p), phi[:few], atol=1e-12)

    by_tree = {}
    for n in nodes:
        by_tree.setdefault(n["treeID"], {})[n["id"]] = n

    def value(tree, node, x, known):
        n = tree[node]
        if n["left"] < 0:
            return n["prediction"]
        a, b = (value(tree, c, x, known) for c in (n["left"], n["right"]))
        if n["feature"] in known:
            return a if x[n["feature"]] <= n["threshold"] else b
        share = tree[n["left"]]["cover"] / n["cover"] if n["cover"] > 0 else 0.0
        rest = tree[n["right"]]["cover"] / n["cover"] if n["cover"] > 0 else 0.0
        return share * a + rest * b

    for row in range(6):
        total = lambda s: sum(w * value(by_tree[t], 0, X[row], s) for t, w in enumerate(weights))
        want = np.zeros(p)
        for i in range(p):
            for r in range(p):
                for s in itertools.combinations([j for j in range(p) if j != i], r):
                    share = math.factorial(r) * math.factorial(p - r - 1) / math.factorial(p)
                    want[i] += share * (total({*s, i}) - total(set(s)))
        assert np.allclose(phi[row], want, atol=1e-10)


def test_an_ensemble_of_500_deep_trees_adds_up():
    """64,000 leaves: base + sum of contributions = the ensemble's value of every row."""
    rng = np.random.default_rng(5)
    nodes, p = _forest(rng, 500, 7, 40), 40
    for n in nodes:
        n["cover"] = max(n["cover"], 1e-3)
    weights = [0.1] * 500
    paths = leaf_paths(nodes, weights)
    assert len(paths) == 64_000
    X = rng.normal(size=(300, p))
    phi = contributions_numpy(X, paths, p)
    trees = {}
    for n in nodes:
        trees.setdefault(n["treeID"], {})[n["id"]] = n

    def leaf(tree, x):
        n = tree[0]
        while n["left"] >= 0:
            n = tree[n["left"] if x[n["feature"]] <= n["threshold"] else n["right"]]
        return n["prediction"]

    for row in (0, 150, 299):
        margin = sum(0.1 * leaf(t, X[row]) for t in trees.values())
        # covers of this forest need not add up, so compare with the value of the empty set of the same paths
        assert abs(phi[row].sum() + expected_value(paths) - margin) < 1e-8
