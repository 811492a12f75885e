"""Registered queries: profiling, missing-rate cut, correlation and feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.scalar import round_doubles
from riskweave.operators.correlate import (
    collinear_drop, numeric_columns, pairwise_corr, pairwise_corr_agg, split_label, target_corr,
    top_bottom, topk_features,
)
from riskweave.operators.select import fit_selection
from riskweave.operators.profile import label_distribution, missing_cut, missing_report, profile
from riskweave.plans import entities as E
from riskweave.plans import features as fx
from riskweave.plans import roles
from riskweave.plans import sqlgen as S
from riskweave.plans.catalog import register
from riskweave.plans.q_features import WIDE_ROLES, wide_sql_parts
from riskweave.sources.tables import TABLES, read_table

KEY, LABEL = E.KEY, E.LABEL
MISSING_THRESHOLD = 75.0
COLLINEAR_THRESHOLD = 0.8
TOP_K = 10


def _wide_with(extra: list[str]) -> str:
    ctes, _ = wide_sql_parts()
    return S.with_roles(*WIDE_ROLES, extra=ctes + extra)


def _wide_feature_cols() -> list[str]:
    return [c for c, _ in wide_sql_parts()[1]]


def _missing_sql(where: str = ""):
    cols = _wide_feature_cols()
    m = ("m AS (SELECT count(*) AS __n,\n  "
         + ",\n  ".join(f"count(*) - count({S.q(c)}) AS {S.q(c)}" for c in cols) + "\n  FROM wide)")
    rep = ("rep AS (SELECT feature, n_missing, CAST(100.0 AS DOUBLE) * n_missing / __n AS pct_missing\n"
           "  FROM (UNPIVOT m ON COLUMNS(* EXCLUDE (__n)) INTO NAME feature VALUE n_missing) u)")
    return _wide_with([m, rep]) + (f"SELECT feature, n_missing, {S.r6('pct_missing')} AS pct_missing "
                                   f"FROM rep {where}")


@register("q_missing_report", lambda: _missing_sql())
def q_missing_report(spark, d):
    """AGG12: missing count and percentage of every wide-table column."""
    wide = fx.wide_table(spark, d)
    return round_doubles(missing_report(wide, exclude=[KEY]))


@register("q_missing_cut", lambda: _missing_sql(f"WHERE pct_missing <= {MISSING_THRESHOLD}"))
def q_missing_cut(spark, d):
    """SEL1: drop columns missing in strictly more than 75 % of rows; report of
    the surviving columns."""
    wide = fx.wide_table(spark, d)
    cut, _ = missing_cut(wide, MISSING_THRESHOLD, protect=[KEY])
    return round_doubles(missing_report(cut, exclude=[KEY]))


def _profile_sql():
    parts = [f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, "
             f"(SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE {t})) AS n_cols"
             for t in TABLES]
    return "\nUNION ALL\n".join(parts)


@register("q_profile", _profile_sql)
def q_profile(spark, d):
    """AGG13: row and column counts of every given table (one job)."""
    return profile({t: read_table(spark, d, t) for t in TABLES})


@register("q_label_distribution", S.with_roles("documents_entity")
          + "SELECT TARGET, count(*) AS n FROM documents_entity WHERE TARGET IS NOT NULL GROUP BY TARGET")
def q_label_distribution(spark, d):
    """AGG14: label value counts."""
    return label_distribution(roles.documents_entity(spark, d))


def _pairs_out(tag: str) -> str:
    return f"SELECT pos_i, pos_j, col_i, col_j, n, {S.r6('r')} AS r FROM {tag}_pairs"


_PAIR_COLS = [LABEL] + E.DOC_NUMERIC


@register("q_corr_pairs", S.with_roles("documents_entity", extra=S.pairs_ctes(
    "documents_entity", KEY, _PAIR_COLS, where="TARGET IS NOT NULL")) + _pairs_out("p"))
def q_corr_pairs(spark, d):
    """SEL2 (few columns): pairwise-complete Pearson r on labelled rows, label
    included, with built-in aggregates."""
    lab = E.labelled(roles.documents_entity(spark, d))
    return round_doubles(pairwise_corr_agg(lab, _PAIR_COLS))


@register("q_corr_gram", lambda: _wide_with(S.pairs_ctes("wide", KEY, _wide_feature_cols())) + _pairs_out("p"))
def q_corr_gram(spark, d):
    """SEL2 (wide): pairwise-complete correlation of all ~220 wide-table columns by
    blocked Gram sums; pairs with no common row have no entry."""
    wide = fx.wide_table(spark, d)
    pc = pairwise_corr(wide, numeric_columns(wide, exclude=[KEY]))
    return round_doubles(pc.where(F.col("n") >= 1))


@register("q_collinear_cut", lambda: _wide_with(S.pairs_ctes("wide", KEY, _wide_feature_cols()))
          + f"SELECT DISTINCT col_j AS feature, pos_j AS pos FROM p_pairs WHERE r > {COLLINEAR_THRESHOLD}")
def q_collinear_cut(spark, d):
    """SEL4-SEL6: columns removed because an EARLIER column has signed r > 0.8 with
    them (removed columns still remove others)."""
    wide = fx.wide_table(spark, d)
    pc = pairwise_corr(wide, numeric_columns(wide, exclude=[KEY]))
    return collinear_drop(pc, COLLINEAR_THRESHOLD)


def _doc_feat_sql():
    onehot = [f"CAST((LANG IS NOT DISTINCT FROM '{v}') AS DOUBLE) AS LANG_{v}" for v in S.LANG]
    onehot.append("CAST((LANG IS NULL) AS DOUBLE) AS LANG_nan")
    onehot += [f"CAST((SOURCE IS NOT DISTINCT FROM '{v}') AS DOUBLE) AS SOURCE_{v}" for v in S.SOURCE]
    onehot.append("CAST((SOURCE IS NULL) AS DOUBLE) AS SOURCE_nan")
    cols = E.DOC_NUMERIC + [f"LANG_{v}" for v in S.LANG] + ["LANG_nan"] + \
        [f"SOURCE_{v}" for v in S.SOURCE] + ["SOURCE_nan"]
    cte = (f"doc_feat AS (SELECT SK_ID_CURR, TARGET, {', '.join(E.DOC_NUMERIC)},\n  "
           + ",\n  ".join(onehot) + "\n  FROM documents_entity)")
    return cte, cols


def _target_top_ctes(k: int):
    cte, cols = _doc_feat_sql()
    casted = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    tc = ("tc AS (SELECT col AS feature,\n"
          f"  {S.r6('CASE WHEN isnan(corr(val, TARGET)) THEN NULL ELSE corr(val, TARGET) END')} AS r\n"
          f"  FROM (UNPIVOT (SELECT TARGET, {casted} FROM doc_feat WHERE TARGET IS NOT NULL)\n"
          "        ON COLUMNS(* EXCLUDE (TARGET)) INTO NAME col VALUE val) u GROUP BY col)")
    tb = ("tb AS (SELECT * FROM (SELECT feature, r, CAST(row_number() OVER (ORDER BY r DESC NULLS LAST, feature) AS INTEGER)"
          " AS rank, 'top' AS side FROM tc) t WHERE rank <= " + str(k) + "\n"
          "  UNION ALL SELECT * FROM (SELECT feature, r, CAST(row_number() OVER (ORDER BY r ASC, feature DESC) AS INTEGER)"
          " AS rank, 'bottom' AS side FROM tc WHERE r IS NOT NULL) b WHERE rank <= " + str(k) + ")")
    return [cte, tc, tb], cols


@register("q_corr_target_top", lambda: S.with_roles("documents_entity", extra=_target_top_ctes(TOP_K)[0])
          + "SELECT feature, r, rank, side FROM tb")
def q_corr_target_top(spark, d):
    """SEL3: the 10 most positive (NULLs last) and 10 most negative correlations
    with the label, on labelled rows."""
    lab = E.labelled(E.doc_features(spark, d))
    tc = target_corr(lab, LABEL, numeric_columns(lab, exclude=[KEY, LABEL]))
    return top_bottom(tc, TOP_K)


def _chosen_ctes(k: int):
    """Label correlations (features without one dropped), the two top-k lists united,
    and the columns that survive the collinearity cut."""
    ctes, cols = _target_top_ctes(k)
    ctes = ctes[:2] + ["usable AS (SELECT feature, r FROM tc WHERE r IS NOT NULL)",
                       "chosen AS (SELECT feature FROM (SELECT feature, row_number() OVER (ORDER BY r DESC, feature) AS a,\n"
                       f"  row_number() OVER (ORDER BY r, feature DESC) AS b FROM usable) t WHERE a <= {k} OR b <= {k})"]
    ctes += S.pairs_ctes("doc_feat", KEY, cols, tag="d", where="TARGET IS NOT NULL")
    ctes.append(f"kept AS (SELECT feature FROM chosen WHERE feature NOT IN "
                f"(SELECT col_j FROM d_pairs WHERE r > {COLLINEAR_THRESHOLD}))")
    return ctes, cols


@register("q_topk_features", lambda: S.with_roles("documents_entity", extra=_chosen_ctes(TOP_K)[0])
          + "SELECT feature FROM kept")
def q_topk_features(spark, d):
    """SEL5-SEL7, SET3-SET4: top-k positive and negative label correlations,
    united, intersected with the columns surviving the collinearity cut. One Gram pass."""
    lab = E.labelled(E.doc_features(spark, d))
    feats = numeric_columns(lab, exclude=[KEY, LABEL])
    between, with_label = split_label(pairwise_corr(lab, [LABEL, *feats]))
    return topk_features(with_label, TOP_K).join(
        collinear_drop(between, COLLINEAR_THRESHOLD).select("feature"), "feature", "left_anti")


# ---------------------------------------------------------------- the whole selection chain
SELECT_K = 8


def _selection_table(spark, d):
    """All documents with features, and a column that is missing in most labelled rows:
    the first cut removes it."""
    return E.doc_features(spark, d).withColumn(
        "RARE", F.when(F.col(KEY) % 10 == 0, F.col("N_CHARS")))


def _select_fit_sql():
    ctes, cols = _chosen_ctes(SELECT_K)
    return (S.with_roles("documents_entity", extra=ctes)
            + f"SELECT feature, TRUE AS kept FROM kept UNION ALL SELECT '{KEY}', TRUE UNION ALL SELECT '{LABEL}', TRUE")


@register("q_select_fit", _select_fit_sql)
def q_select_fit(spark, d):
    """SEL1, SEL4-SEL7 as one fitted selection: missing cut, collinear cut, top-k; names kept."""
    spec = fit_selection(_selection_table(spark, d), LABEL, KEY, MISSING_THRESHOLD, COLLINEAR_THRESHOLD, SELECT_K)
    return spark.createDataFrame([(c, True) for c in spec.keep], "feature string, kept boolean")


def _part_sql(labelled: bool):
    """The selected columns of one part in long form, so that SQL needs no fitted names."""
    ctes, cols = _chosen_ctes(SELECT_K)
    casted = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    side = "IS NOT NULL" if labelled else "IS NULL"
    return (S.with_roles("documents_entity", extra=ctes)
            + f"SELECT {KEY}, CAST(TARGET AS INTEGER) AS TARGET, col AS feature, {S.r6('val')} AS val FROM "
              f"(UNPIVOT (SELECT {KEY}, TARGET, {casted} FROM doc_feat WHERE TARGET {side}) "
              f"ON COLUMNS(* EXCLUDE ({KEY}, TARGET)) INTO NAME col VALUE val) u WHERE col IN (SELECT feature FROM kept)")


def _selected_part(spark, d, labelled: bool):
    table = _selection_table(spark, d)
    spec = fit_selection(table, LABEL, KEY, MISSING_THRESHOLD, COLLINEAR_THRESHOLD, SELECT_K)
    part = spec.transform(table).where(F.col(LABEL).isNotNull() if labelled else F.col(LABEL).isNull())
    feats = [c for c in spec.keep if c not in (KEY, LABEL)]
    part = part.select(KEY, F.col(LABEL).cast("int").alias(LABEL), *[F.col(c).cast("double").alias(c) for c in feats])
    return round_doubles(part.unpivot([KEY, LABEL], feats, "feature", "val").where(F.col("val").isNotNull()))


@register("q_select_train", lambda: _part_sql(True))
def q_select_train(spark, d):
    """SEL6: the labelled part after the fitted selection (long form)."""
    return _selected_part(spark, d, True)


@register("q_select_test", lambda: _part_sql(False))
def q_select_test(spark, d):
    """SEL6: the same fitted columns on the unlabelled part (long form)."""
    return _selected_part(spark, d, False)
