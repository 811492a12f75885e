"""Registered queries: imputation, training, tuning, CV report, refit, run record,
bundle, importances, tree contributions. Model-dependent outputs have no SQL oracle
(rows-only); the imputer has one."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave.functions.scalar import hash_unit, round_doubles
from riskweave.learn import train as L
from riskweave.operators import metrics as M
from riskweave.operators.explain import expected_value, leaf_paths, node_rows, split_counts, tree_contributions
from riskweave.plans import entities as E
from riskweave.plans import models as P
from riskweave.plans import roles
from riskweave.plans import sqlgen as S
from riskweave.plans.catalog import register
from riskweave.session import cut_lineage, scratch_path
from riskweave.sources.bundle import gbt_node_table, load_bundle

KEY, LABEL = E.KEY, E.LABEL


@register("q_impute_indicators", S.with_roles("documents_entity", extra=[
    "x AS (SELECT SK_ID_CURR, CASE WHEN lang <> 'de' THEN N_DIGITS END AS N_DIGITS "
    "FROM documents_entity WHERE TARGET IS NOT NULL)",
    "med AS (SELECT quantile_disc(N_DIGITS, 0.5) AS m FROM x)"]) + """
SELECT SK_ID_CURR, coalesce(N_DIGITS, m) AS N_DIGITS_imp,
  CAST(N_DIGITS IS NULL AS DOUBLE) AS N_DIGITS_isna FROM x, med""")
def q_impute_indicators(spark, d):
    """ML3: the training pipeline's own preprocessing stages (NULL indicator, median
    imputation), with the exact quantile."""
    lab = E.labelled(E.doc_features(spark, d)).select(KEY, "LANG_de", "N_DIGITS")
    x = lab.withColumn("N_DIGITS", F.when(F.col("LANG_de") == 0, F.col("N_DIGITS"))).drop("LANG_de")
    stages, _ = L.preprocess_stages(["N_DIGITS"], ["N_DIGITS"], relative_error=0.0)
    return Pipeline(stages=stages).fit(x).transform(x).select(KEY, "N_DIGITS_imp", "N_DIGITS_isna")


_GAPS = S.with_roles("documents_entity", extra=[
    f"x AS (SELECT SK_ID_CURR, {S.hash_sql('SK_ID_CURR', 9)} >= CASE WHEN TARGET = 1 THEN 0.9 ELSE 0.05 END AS known "
    "FROM documents_entity WHERE TARGET IS NOT NULL)"])


@register("q_missing_direction", _GAPS + "SELECT SK_ID_CURR, CAST(NOT known AS INTEGER) AS prediction, TRUE AS additive FROM x")
def q_missing_direction(spark, d):
    """ML3: one tree with one split over a column that is missing mostly where the label is 1: the split puts the
    missing rows on a side of their own, with no imputation; the two sides' contributions add up to the margin."""
    ent = E.labelled(roles.documents_entity(spark, d)).select(KEY, F.col(LABEL).cast("int").alias(LABEL), "N_CHARS")
    gap = hash_unit(KEY, 9) < F.when(F.col(LABEL) == 1, 0.9).otherwise(0.05)
    x = cut_lineage(ent.withColumn("X", F.when(~gap, F.col("N_CHARS").cast("double"))).select(KEY, LABEL, "X"))
    model = L.fit(x, ["X"], LABEL, maxIter=1, maxDepth=1, stepSize=1.0, subsamplingRate=1.0)
    path = scratch_path(spark, "direction")
    model.write().save(path)
    inputs = model.stages[-2].getInputCols()
    paths = leaf_paths(node_rows(gbt_node_table(spark, path, model)), list(model.stages[-1].treeWeights))
    out = model.transform(x)
    v = vector_to_array("features")
    out = out.select(KEY, F.col("prediction").cast("int").alias("prediction"), vector_to_array("rawPrediction")[1].alias("margin"),
                     *[v[k].alias(f"x{k}") for k in range(len(inputs))])
    phi = tree_contributions(out, [KEY, "prediction", "margin"], [f"x{k}" for k in range(len(inputs))], paths, L.source_columns(inputs, ["X"]))
    return phi.select(KEY, "prediction", (F.abs(F.col("X") + F.lit(expected_value(paths)) - F.col("margin")) < 1e-9).alias("additive"))


@register("q_gbt_predict")
def q_gbt_predict(spark, d):
    """ML1/ML6: GBT fitted on the train part; probability and 0.5-cut class on the
    validation and test parts."""
    t = P.trained(spark, d)
    rest = t.table.where(F.col("split") != "train")
    return L.predict(t.model, rest, [KEY, LABEL, "split"]).drop("margin")


@register("q_grid_search")
def q_grid_search(spark, d):
    """ML4: grid x 5 stratified folds scored by F-beta(10) on class 1, best refit; the numbers of
    trees share their fits."""
    t = P.trained(spark, d)
    _, _, res = L.grid_search(P.training_folds(t), t.features, LABEL, P.QUERY_GRID, "fold", 5, P.BETA)
    return res


@register("q_cv_report")
def q_cv_report(spark, d):
    """ML5: per-metric train mean, test mean and gap over 5 folds."""
    t = P.trained(spark, d)
    return L.cv_report(P.training_folds(t), t.features, LABEL, "fold", 5, P.BETA, **P.MODEL_PARAMS)


@register("q_bundle_roundtrip")
def q_bundle_roundtrip(spark, d):
    """SRC7: the saved bundle loads back and predicts exactly as the fitted model."""
    t = P.trained(spark, d)
    model, meta = load_bundle(spark, t.path)
    rest = t.table.where(F.col("split") != "train")
    a = L.predict(t.model, rest, [KEY]).select(KEY, F.col("proba").alias("p_fitted"))
    b = L.predict(model, rest, [KEY]).select(KEY, F.col("proba").alias("p_loaded"))
    return a.join(b, KEY).select(KEY, "p_fitted", "p_loaded", F.lit(meta["threshold"]).alias("threshold"),
                                 (F.col("p_fitted") == F.col("p_loaded")).alias("same"))


@register("q_split_importance")
def q_split_importance(spark, d):
    """SEL8/XP6: split count per model input over all trees, most used first."""
    t = P.trained(spark, d)
    _, nodes = P.paths_of(spark, t)
    return split_counts(nodes, P.input_names(t))


@register("q_select_best_features")
def q_select_best_features(spark, d):
    """SEL9: training rows restricted to the top-20 split-count features + label."""
    t = P.trained(spark, d)
    best = P.best_features(spark, t)
    return t.table.where(F.col("split") == "train").select(*best, F.col(LABEL).alias("Target"))


@register("q_refit")
def q_refit(spark, d):
    """ML14: refit with the saved parameters on the best features; the tuned
    threshold is carried over, not re-tuned; metrics on the test part."""
    t = P.trained(spark, d)
    meta = P.bundle_meta(spark, t)
    best = P.best_features(spark, t)
    model = L.fit(t.table.where(F.col("split") == "train"), best, LABEL, **meta["params"])
    test = L.predict(model, t.table.where(F.col("split") == "test"), [KEY, LABEL])
    test = M.apply_threshold(test.drop("prediction"), "proba", meta["threshold"])
    m = L.evaluate(test, LABEL, P.BETA)
    return round_doubles(m.select(F.lit(meta["threshold"]).alias("threshold"),
                                  F.lit(len(best)).alias("n_features"), *L.METRIC_NAMES))


@register("q_run_record")
def q_run_record(spark, d):
    """ML15: run rows (parameters, metrics of the training and the validation part, tag)
    appended one after the other to one table."""
    t = P.trained(spark, d)
    path = scratch_path(spark, "runs")
    for part in ("train", "val"):
        pred = L.predict(t.model, t.table.where(F.col("split") == part), [KEY, LABEL])
        m = L.evaluate(pred, LABEL, P.BETA).first().asDict()
        runs = L.run_record(path, spark, f"gbt fbeta10 {part}", L.model_params(t.model),
                            {k: m[k] for k in L.METRIC_NAMES}, tag="grid + threshold sweep")
    return runs


@register("q_tree_contrib")
def q_tree_contrib(spark, d):
    """XP1: exact path-dependent tree contributions per row on the margin scale,
    with the expected value and the model margin (base + sum = margin)."""
    t = P.trained(spark, d)
    paths, _ = P.paths_of(spark, t)
    base = expected_value(paths)
    rest = t.table.where(F.col("split") != "train")
    x = P.assembled(t, rest, [KEY])
    names = [f"phi_{n}" for n in P.input_names(t)]  # a nullable column's two sides are added up
    phi = tree_contributions(x, [KEY, "margin"], [f"x{k}" for k in range(len(names))], paths, names)
    return phi.withColumn("expected_value", F.lit(base))


@register("q_expected_value")
def q_expected_value(spark, d):
    """XP2: expected value = sum over trees of weight x cover-weighted leaf mean,
    one aggregate over the saved node table."""
    t = P.trained(spark, d)
    _, nodes = P.paths_of(spark, t)
    w = F.array(*[F.lit(float(x)) for x in t.model.stages[-1].treeWeights])
    cover = F.col("nodeData.impurityStats")[0]
    per_tree = nodes.groupBy("treeID").agg(
        (F.sum(F.when(F.col("nodeData.leftChild") < 0, F.col("nodeData.prediction") * cover))
         / F.max(F.when(F.col("nodeData.id") == 0, cover))).alias("v"))
    return per_tree.agg(F.sum(w[F.col("treeID")] * F.col("v")).alias("expected_value"))


# ---------------------------------------------------------------- serving with the fitted model
def _prod_for_model(spark, d, t):
    """Unlabelled documents = the clients to score, with the model's features (the
    same NULL rule as the training table) and their 1-based positions."""
    from riskweave.operators.clean import with_position
    ent = E.doc_features(spark, d).where(F.col(LABEL).isNull())
    ent = ent.withColumn("N_DIGITS", F.when(F.col("LANG_de") == 0, F.col("N_DIGITS")))
    return with_position(ent.select(KEY, *t.features), KEY)


@register("q_score_gbt")
def q_score_gbt(spark, d):
    """SC1/SC2 with the saved bundle: every client scored by the GBT model, decided
    with the bundle's tuned threshold (strict >)."""
    from riskweave.operators.score import decide
    t = P.trained(spark, d)
    model, meta = load_bundle(spark, t.path)
    pred = L.predict(model, _prod_for_model(spark, d, t), ["POSITION", KEY])
    cls, dec = decide(F.col("proba"), meta["threshold"])
    return pred.select(F.col("POSITION").alias("Client_id"), KEY, "proba", cls.alias("Class"), dec.alias("Decision"))


def _explained(spark, t, model, found):
    """Found requests with probability, features and contributions, in one pass over the rows."""
    x = P.assembled(t, found, ["request_no", "client_id", *t.features], model)
    paths, _ = P.paths_of(spark, t)
    names = P.input_names(t)
    scored = tree_contributions(x, ["request_no", "client_id", "proba", *t.features],
                                [f"x{k}" for k in range(len(names))], paths, [f"phi_{n}" for n in names])
    return scored, paths, list(dict.fromkeys(names))


@register("q_response_gbt")
def q_response_gbt(spark, d):
    """SC4 as the reference serves it: GBT probability, decision at the bundle's
    threshold, client features and exact tree contributions (margin scale) with the
    expected value, for every found request."""
    from riskweave.operators.score import lookup, response_records, validate_requests
    from riskweave.plans import scoring as SC
    t = P.trained(spark, d)
    model, meta = load_bundle(spark, t.path)
    prod = _prod_for_model(spark, d, t)
    found = lookup(validate_requests(SC.requests(spark, d), "raw", prod.count()), prod)
    scored, paths, names = _explained(spark, t, model, found)
    return response_records(scored, t.features, [f"phi_{n}" for n in names], expected_value(paths),
                            meta["threshold"], with_request_id=False, keep=["request_no"], shap_names=names)


# ---------------------------------------------------------------- invariants of the fitted model that SQL can state
_CLIENTS = S.with_roles("documents_entity") + "SELECT SK_ID_CURR, TRUE AS {} FROM documents_entity WHERE TARGET IS NULL"


@register("q_tree_additivity", _CLIENTS.format("additive"))
def q_tree_additivity(spark, d):
    """XP1/XP2: for every client, expected value + contributions = margin (to 1e-9)."""
    t = P.trained(spark, d)
    paths, _ = P.paths_of(spark, t)
    names = [f"phi_{n}" for n in P.input_names(t)]
    x = P.assembled(t, _clients_for_model(spark, d, t), [KEY])
    phi = tree_contributions(x, [KEY, "margin"], [f"x{k}" for k in range(len(names))], paths, names)
    total = sum((F.col(f"`{n}`") for n in dict.fromkeys(names)), F.lit(expected_value(paths)))
    return phi.select(KEY, (F.abs(total - F.col("margin")) < 1e-9).alias("additive"))


@register("q_bundle_same", _CLIENTS.format("same"))
def q_bundle_same(spark, d):
    """SRC7: for every client, the loaded bundle gives the fitted model's probability."""
    t = P.trained(spark, d)
    model, _ = load_bundle(spark, t.path)
    rows = _clients_for_model(spark, d, t)
    a = L.predict(t.model, rows, [KEY]).select(KEY, F.col("proba").alias("p"))
    b = L.predict(model, rows, [KEY]).select(KEY, F.col("proba").alias("q"))
    return a.join(b, KEY).select(KEY, (F.col("p") == F.col("q")).alias("same"))


@register("q_predict_class_rule", _CLIENTS.format("consistent"))
def q_predict_class_rule(spark, d):
    """ML6: for every client, the class is 1 exactly when the probability is above one half, the
    probability lies in [0, 1], and the margin is half its log odds."""
    t = P.trained(spark, d)
    pred = L.predict(t.model, _clients_for_model(spark, d, t), [KEY])
    p = F.col("proba")
    odds = F.abs(F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * F.col("margin"))) - p) < 1e-9
    return pred.select(KEY, (((p > 0.5).cast("int") == F.col("prediction")) & p.between(0, 1) & odds).alias("consistent"))


def _clients_for_model(spark, d, t):
    ent = E.doc_features(spark, d).where(F.col(LABEL).isNull())
    return ent.withColumn("N_DIGITS", F.when(F.col("LANG_de") == 0, F.col("N_DIGITS"))).select(KEY, *t.features)


# ---------------------------------------------------------------- streaming with the fitted model
@register("q_stream_response")
def q_stream_response(spark, d):
    """SC6 with the bundle: requests arrive as files; each is validated, joined to the clients,
    scored by the loaded GBT model, decided, explained and appended to a parquet sink."""
    from riskweave.operators.score import lookup, response_records, validate_requests
    from riskweave.plans import scoring as SC
    from riskweave.streaming.score_stream import request_stream, run_available_now
    t = P.trained(spark, d)
    model, meta = load_bundle(spark, t.path)
    prod_dir, req_dir = scratch_path(spark, "clients"), scratch_path(spark, "requests")
    _prod_for_model(spark, d, t).write.parquet(prod_dir)
    SC.requests(spark, d).write.parquet(req_dir)
    prod = spark.read.parquet(prod_dir)
    valid = validate_requests(request_stream(spark, req_dir, SC.REQUEST_SCHEMA), "raw", prod.count())
    scored, paths, names = _explained(spark, t, model, lookup(valid, prod))
    out = response_records(scored, t.features, [f"phi_{n}" for n in names], expected_value(paths), meta["threshold"],
                           with_request_id=False, keep=["request_no"], shap_names=names)
    sink = scratch_path(spark, "responses")
    plain = out.select(*[F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in out.columns])
    run_available_now(plain, sink, scratch_path(spark, "stream-ckpt"))
    return spark.read.parquet(sink)
