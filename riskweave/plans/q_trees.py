"""Tree operators on a small fixed ensemble over the documents, so that SQL can state the
exact result. The SQL is written from the definition (Shapley values of the
cover-weighted value function over all subsets), not from the leaf-path code."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.sql import functions as F

from riskweave.functions.scalar import round_doubles
from riskweave.operators.explain import expected_value, leaf_paths, node_rows, split_counts, split_gains, tree_contributions
from riskweave.plans import entities as E
from riskweave.plans import roles
from riskweave.plans import sqlgen as S
from riskweave.plans.catalog import register

KEY = E.KEY
FEATURES = ["N_CHARS", "N_DIGITS", "N_UPPER", "N_EXCLAIM"]
WEIGHTS = [1.0, 0.5]
# Fixed values: (node, prediction, cover, left, right, feature, threshold) of two trees of depth 2.
TREES = [
    [(0, 0.1, 100.0, 1, 4, 0, 1500.0), (1, -0.2, 60.0, 2, 3, 1, 10.0), (2, -0.4, 45.0, -1, -1, -1, None),
     (3, 0.3, 15.0, -1, -1, -1, None), (4, 0.4, 40.0, 5, 6, 2, 40.0), (5, 0.1, 25.0, -1, -1, -1, None),
     (6, 0.9, 15.0, -1, -1, -1, None)],
    [(0, 0.1, 100.0, 1, 4, 3, 2.0), (1, 0.0, 70.0, 2, 3, 0, 400.0), (2, 0.2, 30.0, -1, -1, -1, None),
     (3, -0.25, 40.0, -1, -1, -1, None), (4, 0.6, 30.0, -1, -1, -1, None)],
]
NODE_SCHEMA = ("treeID int, nodeData struct<id:int,prediction:double,impurityStats:array<double>,leftChild:int,"
               "rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>>>")


def node_table(spark, trees=TREES):
    """An ensemble in the layout of a saved model's node table."""
    return spark.createDataFrame([(t, (i, p, [c], left, right, (f, [] if thr is None else [thr])))
                                  for t, tree in enumerate(trees) for i, p, c, left, right, f, thr in tree], NODE_SCHEMA)


def _value(tree, node: int, known: frozenset) -> str:
    """SQL of a node's value when only the features in ``known`` are known."""
    _, p, cover, left, right, f, thr = tree[node]
    if left < 0:
        return f"CAST({p} AS DOUBLE)"
    a, b = _value(tree, left, known), _value(tree, right, known)
    if f in known:
        return f"(CASE WHEN {FEATURES[f]} <= {thr} THEN {a} ELSE {b} END)"
    return f"(({tree[left][2]} * {a} + {tree[right][2]} * {b}) / CAST({cover} AS DOUBLE))"


def _shapley(i: int) -> str:
    terms, p = [], len(FEATURES)
    for w, tree in zip(WEIGHTS, TREES):
        others = [j for j in range(p) if j != i]
        for r in range(p):
            for s in combinations(others, r):
                share = w * factorial(r) * factorial(p - r - 1) / factorial(p)
                terms.append(f"CAST('{share!r}' AS DOUBLE) * ({_value(tree, 0, frozenset(s) | {i})} - {_value(tree, 0, frozenset(s))})")
    return " + ".join(terms)


@register("q_tree_contrib_fixed", lambda: S.with_roles("documents_entity") + f"SELECT {KEY}, " + ", ".join(
    f"{S.r6('(' + _shapley(i) + ')')} AS phi_{f}" for i, f in enumerate(FEATURES)) + " FROM documents_entity")
def q_tree_contrib_fixed(spark, d):
    """XP1 on the fixed ensemble, for every document."""
    paths = leaf_paths(node_rows(node_table(spark)), WEIGHTS)
    docs = roles.documents_entity(spark, d)
    return round_doubles(tree_contributions(docs, KEY, FEATURES, paths, [f"phi_{f}" for f in FEATURES]))


def _nodes_with_covers(docs) -> list[list[tuple]]:
    """The fixed trees' splits and leaf values with each node's cover counted on the documents: one aggregate."""
    conditions = {}

    def walk(t: int, node: int, upto) -> None:
        _, _, _, left, right, f, thr = TREES[t][node]
        conditions[t, node] = upto
        if left >= 0:
            goes_left = F.col(FEATURES[f]) <= thr
            walk(t, left, upto & goes_left)
            walk(t, right, upto & ~goes_left)

    for t in range(len(TREES)):
        walk(t, 0, F.lit(True))
    row = docs.agg(*[F.count_if(c).alias(f"n{t}_{i}") for (t, i), c in conditions.items()]).first()  # a number per node
    return [[(i, p, float(row[f"n{t}_{i}"]), left, right, f, thr) for i, p, _, left, right, f, thr in tree] for t, tree in enumerate(TREES)]


def _leaf_sql(tree, node: int) -> str:
    _, p, _, left, right, f, thr = tree[node]
    return f"CAST({p} AS DOUBLE)" if left < 0 else f"CASE WHEN {FEATURES[f]} <= {thr} THEN {_leaf_sql(tree, left)} ELSE {_leaf_sql(tree, right)} END"


@register("q_expected_value_fixed", lambda: S.with_roles("documents_entity") + "SELECT count(*) AS n, "
          + S.r6("avg(" + " + ".join(f"{w} * ({_leaf_sql(t, 0)})" for w, t in zip(WEIGHTS, TREES)) + ")") + " AS expected_value FROM documents_entity")
def q_expected_value_fixed(spark, d):
    """XP2 on the fixed splits with covers counted on the documents: the cover-weighted expected value is then the
    mean of the ensemble over the documents."""
    docs = roles.documents_entity(spark, d)
    trees = _nodes_with_covers(docs)
    base = expected_value(leaf_paths(node_rows(node_table(spark, trees)), WEIGHTS))
    return round_doubles(docs.agg(F.count(F.lit(1)).alias("n"), F.lit(base).alias("expected_value")))


_LEANING = "q AS (SELECT SOURCE, " + ", ".join(f"avg({f}) / (SELECT avg({f}) FROM documents_entity) AS r{i}" for i, f in enumerate(FEATURES)) + \
    " FROM documents_entity GROUP BY SOURCE)"
_MOST = "greatest(" + ", ".join(f"r{i}" for i in range(len(FEATURES))) + ")"


@register("q_split_counts_fixed", lambda: S.with_roles("documents_entity", extra=[_LEANING]) + "SELECT feature, count(*) AS split_count FROM (SELECT CASE "
          + " ".join(f"WHEN r{i} = {_MOST} THEN '{f}'" for i, f in enumerate(FEATURES)) + " END AS feature FROM q) s GROUP BY feature")
def q_split_counts_fixed(spark, d):
    """SEL8/XP6 on a node table made from the documents: for every source a tree with one split, on the
    feature whose mean stands out most from the mean of all documents."""
    docs = roles.documents_entity(spark, d)
    whole = docs.agg(*[F.avg(f).alias(f) for f in FEATURES]).first()
    each = docs.groupBy("SOURCE").agg(*[(F.avg(f) / whole[f]).alias(f"r{i}") for i, f in enumerate(FEATURES)])
    ratios = [F.col(f"r{i}") for i in range(len(FEATURES))]
    index = F.coalesce(*[F.when(r == F.greatest(*ratios), i) for i, r in enumerate(ratios)])
    leaf = lambda i: f"struct({i} AS id, -1 AS leftChild, -1 AS rightChild, struct(-1 AS featureIndex) AS split)"
    nodes = each.select(index.alias("fi")).select(F.explode(F.expr(
        f"array(struct(0 AS id, 1 AS leftChild, 2 AS rightChild, struct(fi AS featureIndex) AS split), {leaf(1)}, {leaf(2)})")).alias("nodeData"))
    return split_counts(nodes, FEATURES)


def _gain_sql() -> str:
    y = "CAST(N_DIGITS AS DOUBLE)"
    return S.with_roles("documents_entity", extra=[
        "cuts AS (SELECT SOURCE AS s, " + ", ".join(f"avg(CAST({f} AS DOUBLE)) AS c{i}" for i, f in enumerate(FEATURES)) + " FROM documents_entity GROUP BY SOURCE)",
        "sides AS (" + " UNION ALL ".join(
            f"SELECT SOURCE, '{f}' AS feature, {y} AS y, CAST({f} AS DOUBLE) <= c{i} AS side FROM documents_entity JOIN cuts ON SOURCE IS NOT DISTINCT FROM s"
            for i, f in enumerate(FEATURES)) + ")",
        "each AS (SELECT feature, SOURCE, var_pop(y) * count(*) AS whole FROM sides GROUP BY feature, SOURCE)",
        "halves AS (SELECT feature, SOURCE, sum(v) AS rest FROM (SELECT feature, SOURCE, side, var_pop(y) * count(*) AS v FROM sides"
        " GROUP BY feature, SOURCE, side) h GROUP BY feature, SOURCE)",
    ]) + (f"SELECT e.feature, {S.r6('sum((whole - rest) / 1000)')} AS split_gain FROM each e JOIN halves h "
          "ON e.feature = h.feature AND e.SOURCE IS NOT DISTINCT FROM h.SOURCE GROUP BY e.feature")


@register("q_split_gains_fixed", _gain_sql)
def q_split_gains_fixed(spark, d):
    """SEL8, gain variant, on a node table made from the documents: for every source and feature a tree with one split at
    the feature's mean, its gain the variance of the digit counts that the split removes."""
    docs = roles.documents_entity(spark, d)
    y = F.col("N_DIGITS").cast("double")
    cuts = docs.groupBy(F.col("SOURCE").alias("s")).agg(*[F.avg(F.col(f).cast("double")).alias(f"c{i}") for i, f in enumerate(FEATURES)])
    at = docs.join(cuts, F.col("SOURCE").eqNullSafe(F.col("s")))
    sides = at.select("SOURCE", y.alias("y"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("fi"), (F.col(f).cast("double") <= F.col(f"c{i}")).alias("side")) for i, f in enumerate(FEATURES)])).alias("x"))
    halves = sides.groupBy("SOURCE", "x.fi", "x.side").agg(F.count("y").alias("n"), F.sum("y").alias("t"), F.sum(F.col("y") * F.col("y")).alias("q"))
    spread = lambda n, t, q: q - t * t / n  # noqa: E731  sum of squared deviations
    trees = halves.groupBy("SOURCE", "fi").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("q").alias("q"),
                                               F.sum(spread(F.col("n"), F.col("t"), F.col("q"))).alias("rest"))
    gain = (spread(F.col("n"), F.col("t"), F.col("q")) - F.col("rest")) / F.col("n") / 1000
    nodes = trees.select(F.struct(F.lit(0).alias("id"), F.lit(1).alias("leftChild"), gain.alias("gain"), F.array(F.col("n").cast("double")).alias("impurityStats"),
                                  F.struct(F.col("fi").alias("featureIndex")).alias("split")).alias("nodeData"))
    return round_doubles(split_gains(nodes, FEATURES))
