"""Explanations (XP1-XP7).

* tree contributions: exact path-dependent Shapley values of a Spark GBT model,
  computed per leaf path. The leaf list (bounded by maxIter x 2^maxDepth) is built
  from the saved node table and broadcast; rows are processed
  in Arrow batches by ``mapInPandas`` with numpy.
* linear contributions: pure column expressions (the SQL-checkable twin).
* waterfall: arrays of the client's own row; global importance: one aggregate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.session import ship_package


@dataclass
class LeafPath:
    value: float          # leaf prediction x tree weight
    features: list[int]   # distinct features on the path
    z: list[float]        # per feature: product of child/parent cover ratios
    steps: list[tuple[int, float, bool]]  # (feature, threshold, go_left) from the root to the leaf


def leaf_paths(nodes: list[dict], tree_weights: list[float]) -> list[LeafPath]:
    """Flatten trees to leaf paths, depth first, so that leaves next to each other share the most
    steps. ``nodes``: dicts with treeID, id, prediction, cover, left, right, feature, threshold."""
    by_tree: dict[int, dict[int, dict]] = {}
    for n in nodes:
        by_tree.setdefault(n["treeID"], {})[n["id"]] = n
    out = []
    for t, tree in by_tree.items():
        w = tree_weights[t]
        stack = [(0, [])]  # (node id, [(feature, threshold, go_left, ratio)])
        while stack:
            nid, path = stack.pop()
            n = tree[nid]
            if n["left"] < 0:
                ratio: dict[int, float] = {}
                for f, _, _, r in path:
                    ratio[f] = ratio.get(f, 1.0) * r
                out.append(LeafPath(w * n["prediction"], list(ratio), list(ratio.values()), [step[:3] for step in path]))
                continue
            c = n["cover"]
            for child, left in ((n["left"], True), (n["right"], False)):
                r = tree[child]["cover"] / c if c > 0 else 0.0
                stack.append((child, path + [(n["feature"], n["threshold"], left, r)]))
    return out


def expected_value(paths: list[LeafPath]) -> float:
    """XP2: sum over leaves of value x product of cover ratios on the path."""
    return float(sum(p.value * float(np.prod(p.z)) for p in paths))


@lru_cache
def _quadrature(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights on [0, 1] that integrate polynomials of degree d - 1 exactly."""
    t, w = np.polynomial.legendre.leggauss((d + 1) // 2)
    return (t + 1) / 2, w / 2


def leaf_terms(value: float, z: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Contributions (d x codes) of one leaf to its d path features. Bit j of a code tells whether a
    row meets all conditions on feature j. With o the bits, feature k gets value (o_k - z_k) times the mean over all
    orders of the product of o_j before k and z_j after k: the integral over t in [0, 1] of
    prod_{j != k} (t o_j + (1 - t) z_j), a polynomial of degree d - 1."""
    d = len(z)
    t, w = _quadrature(d)
    o = ((codes >> np.arange(d)[:, None]) & 1).astype(np.float64)
    factors = t[:, None] * o[:, None, :] + ((1 - t) * z[:, None])[:, :, None]  # d x points x codes
    others = np.ones_like(factors)  # products of the factors before k, then times those after k
    np.cumprod(factors[:-1], axis=0, out=others[1:])
    others[:-1] *= np.cumprod(factors[:0:-1], axis=0)[::-1]
    return value * (o - z[:, None]) * np.einsum("q,kqc->kc", w, others)


def contributions_numpy(X: np.ndarray, paths: list[LeafPath], p: int) -> np.ndarray:
    """phi (n x p) for rows X (n x p), exact path-dependent Shapley values. Rows carry one integer per
    leaf, whose bits are extended step by step from the root; steps shared with the leaf before are
    not evaluated again. A leaf's terms are worked out for every code (or for the rows, if they are
    fewer) and added to its own features only. As in the trees, a missing value goes right."""
    n = X.shape[0]
    columns, phi = np.ascontiguousarray(X.T), np.zeros((p, n))
    shared: list[tuple[tuple, np.ndarray]] = []  # steps of the leaf before and the codes after each
    for leaf in paths:
        if not leaf.features:
            continue
        same = 0
        while same < len(shared) and same < len(leaf.steps) and shared[same][0] == leaf.steps[same]:
            same += 1
        del shared[same:]
        seen = list(dict.fromkeys(f for f, _, _ in leaf.steps[:same]))
        codes = shared[-1][1] if shared else np.zeros(n, dtype=np.int64)
        for step in leaf.steps[same:]:
            f, threshold, left = step
            meets = columns[f] <= threshold
            if not left:
                meets = ~meets
            if f in seen:
                codes = np.where(meets, codes, codes & ~(1 << seen.index(f)))
            else:
                codes = codes | (meets.astype(np.int64) << len(seen))
                seen.append(f)
            shared.append((step, codes))
        z, every = np.array(leaf.z), 1 << len(seen)
        by_code = every <= n
        for f, term in zip(seen, leaf_terms(leaf.value, z, np.arange(every) if by_code else codes)):
            phi[f] += term.take(codes) if by_code else term
    return phi.T


def tree_contributions(df: DataFrame, keep: str | list[str], feature_cols: list[str], paths: list[LeafPath],
                       feature_names: list[str] | None = None) -> DataFrame:
    """XP1: wide table (kept columns, phi_<feature>...) of additive contributions on the
    model's margin scale; base + sum(phi) = margin. Inputs that share a name in ``feature_names``
    (the two sides of a nullable column) are added up. ``keep`` columns pass through, so
    nothing has to be joined back. The leaf paths travel as one broadcast (a bounded
    node table), not in every task's closure."""
    keep = [keep] if isinstance(keep, str) else list(keep)
    each = feature_names or feature_cols
    names = list(dict.fromkeys(each))
    p = len(feature_cols)
    onto = np.zeros((p, len(names)))
    onto[np.arange(p), [names.index(n) for n in each]] = 1.0
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField(n, T.DoubleType()) for n in names])
    x = df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(feature_cols)])
    ship_package(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(paths)

    def run(batches):
        for pdf in batches:
            X = pdf[[f"x{k}" for k in range(p)]].to_numpy(dtype=np.float64)
            phi = pd.DataFrame(contributions_numpy(X, held.value, p) @ onto, columns=names, index=pdf.index)
            yield pd.concat([pdf[keep], phi], axis=1)
    return x.mapInPandas(run, schema)


def linear_phi(fit_on: DataFrame, cols: list[str], weights: list[float]) -> dict[str, Column]:
    """phi_i = w_i (x_i - mean_i) / sd_i as columns; means and standard deviations from
    one aggregate over ``fit_on`` (2p numbers reach the driver)."""
    stats = fit_on.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(cols)],
                   *[F.stddev_samp(c).alias(f"s{k}") for k, c in enumerate(cols)]).first()
    out = {}
    for k, (c, w) in enumerate(zip(cols, weights)):
        m, s = stats[f"m{k}"], stats[f"s{k}"]
        phi = F.lit(0.0) if m is None or not s else F.lit(float(w)) * (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
        out[c] = F.coalesce(phi, F.lit(0.0))
    return out


def linear_contributions(df: DataFrame, key: str, cols: list[str], weights: list[float],
                         fit_on: DataFrame | None = None) -> tuple[DataFrame, float]:
    """XP7: contributions of the standardised linear scorer as a long table (key,
    feature, phi); base = 0 (the margin at the means). ``fit_on``: the rows that give
    means and deviations, default ``df``."""
    phi = linear_phi(df if fit_on is None else fit_on, cols, weights)
    terms = [F.struct(F.lit(c).alias("feature"), p.alias("phi")) for c, p in phi.items()]
    long = df.select(key, F.explode(F.array(*terms)).alias("t")).select(key, "t.feature", "t.phi")
    return long, 0.0


def global_importance(long: DataFrame) -> DataFrame:
    """XP3: mean |phi| per feature."""
    return long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))


def waterfall(df: DataFrame, key: str, phi: dict[str, Column], base: float, top: int = 15,
              other: bool = False) -> DataFrame:
    """XP5: per client the ``top`` largest |phi| (ties by feature name, later first), drawn in
    ascending |phi| order from the base: end = base + running sum, start = end - phi.
    ``phi`` maps features to contribution columns of the client's own row, so
    everything happens in arrays of that row: no shuffle. ``other=True`` adds one first
    step with the sum of the remaining features, so the last ``end`` is the full margin."""
    items = F.array(*[F.struct(c.cast("double").alias("phi"), F.lit(f).alias("feature")) for f, c in phi.items()])
    order = lambda a, b: (F.when(F.abs(a["phi"]) < F.abs(b["phi"]), -1).when(F.abs(a["phi"]) > F.abs(b["phi"]), 1)
                          .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0))
    x = df.select(key, F.array_sort(items, order).alias("_a"))
    cut = F.greatest(F.size("_a") - F.lit(top), F.lit(0))
    kept = F.slice("_a", cut + 1, F.greatest(F.size("_a") - cut, F.lit(0)))
    if other:
        rest = F.aggregate(F.slice("_a", F.lit(1), cut), F.lit(0.0), lambda t, e: t + e["phi"])
        kept = F.concat(F.when(cut > 0, F.array(F.struct(rest.alias("phi"), F.lit("other").alias("feature"))))
                        .otherwise(F.slice("_a", F.lit(1), F.lit(0))), kept)
    x = x.select(key, kept.alias("_k"))
    ends = F.aggregate("_k", F.array(F.lit(float(base))), lambda t, e: F.concat(t, F.array(F.element_at(t, -1) + e["phi"])))
    x = x.select(key, F.posexplode(F.arrays_zip(F.col("_k").alias("k"), F.slice(ends, F.lit(2), F.size("_k")).alias("end"))))
    out = x.select(key, F.col("col.k.feature").alias("feature"), F.col("col.k.phi").alias("phi"),
                   (F.col("pos") + 1).alias("step"), F.col("col.end").alias("end"))
    return out.select(key, "feature", "phi", "step", (F.col("end") - F.col("phi")).alias("start"), "end",
                      F.when(F.col("phi") > 0, F.lit("increase")).otherwise(F.lit("decrease")).alias("direction"))


def split_counts(nodes: DataFrame, feature_names: list[str]) -> DataFrame:
    """SEL8/XP6: number of splits per feature over all trees (from the node table); inputs of one name count together."""
    names = F.array(*[F.lit(n) for n in feature_names])
    internal = nodes.where(F.col("nodeData.leftChild") >= 0)
    return (internal.groupBy(names[F.col("nodeData.split.featureIndex")].alias("feature"))
            .agg(F.count(F.lit(1)).alias("split_count")))


def node_rows(nodes: DataFrame) -> list[dict]:
    """Collect the node table (size bounded by maxIter x 2^(maxDepth+1))."""
    rows = nodes.select("treeID", "nodeData.id", "nodeData.prediction",
                        F.col("nodeData.impurityStats")[0].alias("cover"),
                        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
                        F.col("nodeData.split.featureIndex").alias("feature"),
                        F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), 0).alias("threshold")).collect()
    return [r.asDict() for r in rows]


def split_gains(nodes: DataFrame, feature_names: list[str]) -> DataFrame:
    """SEL8, gain variant: per feature the loss reduction of all its splits, a node's gain times its rows (the gain is an
    average over them); inputs of one name count together."""
    names = F.array(*[F.lit(n) for n in feature_names])
    internal = nodes.where(F.col("nodeData.leftChild") >= 0)
    return (internal.groupBy(names[F.col("nodeData.split.featureIndex")].alias("feature"))
            .agg(F.sum(F.col("nodeData.gain") * F.col("nodeData.impurityStats")[0]).alias("split_gain")))
