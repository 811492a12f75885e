"""Registered queries: scans and sinks, row-level cleaning, encoders, single aggregates."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from riskweave.functions.scalar import (
    find_bad_names, hash_unit, null_safe_ne, positive_part, ratio, round_doubles, sanitize_columns,
)
from riskweave.operators.aggregate import Subset, category_share_exprs, grouped
from riskweave.operators.clean import label_split, narrow_types, union_by_name, with_position
from riskweave.operators.encode import FactorizeSpec, OneHotSpec, SparseOneHot, category_shares
from riskweave.plans import features as fx
from riskweave.plans import roles
from riskweave.plans import sqlgen as S
from riskweave.plans.catalog import register
from riskweave.plans.q_features import _app_sql_parts, _ins_sql_parts, _prev_sql_parts
from riskweave.session import scratch_path
from riskweave.sources.tables import (
    head_of_files, head_rows, read_csv, read_csv_checked, read_table, with_file_position, write_csv, write_parquet,
)

KEY = "SK_ID_CURR"
CUSTOMER_SCHEMA = ("c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                   "c_mktsegment STRING")


# ---------------------------------------------------------------- scans and sinks
@register("q_scan_project", """
SELECT l_orderkey, l_quantity, l_extendedprice, l_discount FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'""")
def q_scan_project(spark, d):
    """SRC3/SRC5: parquet scan, projection to a feature list and a filter, both
    pushed into the scan (ReadSchema has 5 columns, PushedFilters the date)."""
    li = read_table(spark, d, "lineitem")
    return (li.where(F.expr("l_shipdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00'"))
            .select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount"))


@register("q_scan_limit_count", "SELECT count(*) AS n_rows FROM (SELECT * FROM lineitem LIMIT 1000)")
def q_scan_limit_count(spark, d):
    """SRC2: head-N limit on a scan (the limit is the feature)."""
    return head_rows(read_table(spark, d, "lineitem"), 1000).agg(F.count(F.lit(1)).alias("n_rows"))


@register("q_head_of_files", S.with_roles("application") + """SELECT SK_ID_CURR, NAME_SEGMENT
FROM application QUALIFY row_number() OVER (PARTITION BY NAME_SEGMENT ORDER BY SK_ID_CURR DESC) <= 40""")
def q_head_of_files(spark, d):
    """SRC2: the first 40 rows of EACH file of a table with one file a segment, largest keys first."""
    path = scratch_path(spark, "by-segment")
    app = roles.application(spark, d).select(KEY, "NAME_SEGMENT")
    app.repartition("NAME_SEGMENT").sortWithinPartitions("NAME_SEGMENT", F.desc(KEY)).write.partitionBy("NAME_SEGMENT").parquet(path)
    return head_of_files(spark, path, 40)


@register("q_file_position", S.with_roles("application") + f"""SELECT SK_ID_CURR,
  row_number() OVER (ORDER BY {S.hash_sql('SK_ID_CURR', 5)}, SK_ID_CURR) AS POSITION FROM application""")
def q_file_position(spark, d):
    """PRJ2 / JN5: positions in the order of the files, of a table written in an order that is not the key's."""
    path = scratch_path(spark, "hash-order")
    app = roles.application(spark, d).select(KEY)
    app.repartitionByRange(5, hash_unit(KEY, 5), KEY).sortWithinPartitions(hash_unit(KEY, 5), KEY).write.parquet(path)
    return with_file_position(spark, path)


@register("q_csv_rejects", """SELECT CASE c_custkey % 40 WHEN 0 THEN 'short' WHEN 1 THEN 'long' WHEN 2 THEN 'number' ELSE 'row' END AS kind,
  count(*) AS n, CAST(sum(CASE WHEN c_custkey % 40 > 2 THEN c_custkey END) AS BIGINT) AS keys FROM customer GROUP BY ALL""")
def q_csv_rejects(spark, d):
    """SRC1: a CSV file in which some lines lack a field, have one too many or hold a word for a number: rows that
    fit the schema, and the rejects beside them."""
    c, k = read_table(spark, d, "customer"), F.col("c_custkey")
    fields = F.concat_ws(",", k.cast("string"), "c_name", F.col("c_nationkey").cast("string"))
    line = (F.when(k % 40 == 0, fields).when(k % 40 == 1, F.concat_ws(",", fields, F.lit("1.5"), F.col("c_mktsegment"), F.lit("more")))
            .when(k % 40 == 2, F.concat_ws(",", fields, F.lit("plenty"), "c_mktsegment"))
            .otherwise(F.concat_ws(",", fields, F.col("c_acctbal").cast("string"), "c_mktsegment")))
    path = scratch_path(spark, "csv-broken")
    c.select(line.alias("value")).write.text(path)
    good, bad = read_csv_checked(spark, path, CUSTOMER_SCHEMA, header=False)
    commas = F.length("_line") - F.length(F.translate("_line", ",", ""))
    kind = F.when(commas < 4, "short").when(commas > 4, "long").otherwise("number")
    return (good.agg(F.lit("row").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))
            .unionByName(bad.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("keys"))))


@register("q_csv_roundtrip", "SELECT * FROM customer")
def q_csv_roundtrip(spark, d):
    """SRC1/SRC4/SRC6: CSV sink with header into a new folder, CSV scan with a
    declared schema."""
    path = scratch_path(spark, "csv-roundtrip")
    write_csv(read_table(spark, d, "customer"), path)
    return read_csv(spark, path, CUSTOMER_SCHEMA)


@register("q_parquet_roundtrip", lambda: S.with_roles("application", extra=_app_sql_parts()[0])
          + f"SELECT SK_ID_CURR,\n  {S.rounded(_app_sql_parts()[1])}\nFROM app_feat")
def q_parquet_roundtrip(spark, d):
    """SRC4: client features written as parquet and scanned back."""
    path = scratch_path(spark, "parquet-roundtrip")
    write_parquet(fx.application_features(spark, d), path)
    return round_doubles(spark.read.parquet(path))


# ---------------------------------------------------------------- row-level cleaning
_SEG_NULLED = "NULLIF(NAME_SEGMENT, 'HOUSEHOLD')"


def _app_seg_nulled(spark, d):
    """Client table with one segment turned into NULL (the NULL case is made inside
    the query, identically in the oracle)."""
    app = roles.application(spark, d)
    return app.withColumn("NAME_SEGMENT", F.nullif(F.col("NAME_SEGMENT"), F.lit("HOUSEHOLD")))


@register("q_null_safe_exclude", S.with_roles("application") + f"""
SELECT SK_ID_CURR, {_SEG_NULLED} AS NAME_SEGMENT FROM application
WHERE {_SEG_NULLED} IS DISTINCT FROM 'MACHINERY'""")
def q_null_safe_exclude(spark, d):
    """PRJ1: exclusion filter that keeps NULL rows."""
    app = _app_seg_nulled(spark, d)
    return app.where(null_safe_ne("NAME_SEGMENT", "MACHINERY")).select(KEY, "NAME_SEGMENT")


@register("q_sentinel_null", lambda: S.with_roles("previous_application", extra=_prev_sql_parts()[0][:1])
          + "SELECT SK_ID_PREV, DAYS_DECISION, DAYS_FIRST_DUE FROM prev_prep")
def q_sentinel_null(spark, d):
    """PRJ3: the 'unknown date' marker becomes NULL."""
    return fx.previous_prepared(spark, d).select("SK_ID_PREV", "DAYS_DECISION", "DAYS_FIRST_DUE")


@register("q_ratios", S.with_roles("application") + f"""
SELECT SK_ID_CURR, {S.r6('AMT_BALANCE')} AS AMT_BALANCE, NATION_CODE,
  {S.r6('AMT_BALANCE / NULLIF(NATION_CODE, 0)')} AS BALANCE_PER_NATION,
  {S.r6('NATION_CODE / NULLIF(AMT_BALANCE, 0)')} AS NATION_PER_BALANCE
FROM application""")
def q_ratios(spark, d):
    """PRJ4: ratio features; a zero denominator gives NULL (nation 0 exists)."""
    app = roles.application(spark, d)
    return round_doubles(app.select(
        KEY, "AMT_BALANCE", "NATION_CODE",
        ratio("AMT_BALANCE", "NATION_CODE").alias("BALANCE_PER_NATION"),
        ratio("NATION_CODE", "AMT_BALANCE").alias("NATION_PER_BALANCE")))


def _ins_prep_sql():
    return S.with_roles("installments", extra=_ins_sql_parts()[0][:1])


@register("q_diff", lambda: _ins_prep_sql() + f"""
SELECT SK_ID_CURR, NUM_INSTALMENT_VERSION, {S.r6('AMT_INSTALMENT')} AS AMT_INSTALMENT,
  {S.r6('AMT_PAYMENT')} AS AMT_PAYMENT, {S.r6('PAYMENT_DIFF')} AS PAYMENT_DIFF,
  {S.r6('PAYMENT_PERC')} AS PAYMENT_PERC
FROM ins_prep""")
def q_diff(spark, d):
    """PRJ5: difference (and percentage) features per installment row."""
    ins = fx.installments_prepared(spark, d)
    return round_doubles(ins.select(KEY, "NUM_INSTALMENT_VERSION", "AMT_INSTALMENT", "AMT_PAYMENT",
                                    "PAYMENT_DIFF", "PAYMENT_PERC"))


@register("q_positive_part", S.with_roles("installments") + """
SELECT SK_ID_CURR, NUM_INSTALMENT_VERSION, DEP AS DAYS_ENTRY_PAYMENT, DAYS_INSTALMENT,
  CASE WHEN DEP - DAYS_INSTALMENT > 0 THEN DEP - DAYS_INSTALMENT ELSE 0 END AS DPD,
  CASE WHEN DAYS_INSTALMENT - DEP > 0 THEN DAYS_INSTALMENT - DEP ELSE 0 END AS DBD
FROM (SELECT *, CASE WHEN NUM_INSTALMENT_VERSION <> 7 THEN DAYS_ENTRY_PAYMENT END AS DEP
      FROM installments) t""")
def q_positive_part(spark, d):
    """PRJ6: days past due / before due, positive part; a NULL payment day gives 0
    (payment day made NULL on line 7)."""
    ins = roles.installments(spark, d).withColumn(
        "DAYS_ENTRY_PAYMENT", F.when(F.col("NUM_INSTALMENT_VERSION") != 7, F.col("DAYS_ENTRY_PAYMENT")))
    return ins.select(
        KEY, "NUM_INSTALMENT_VERSION", "DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT",
        positive_part(F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")).alias("DPD"),
        positive_part(F.col("DAYS_INSTALMENT") - F.col("DAYS_ENTRY_PAYMENT")).alias("DBD"))


@register("q_row_position", S.with_roles("application") + f"""
SELECT SK_ID_CURR, {S.r6('AMT_BALANCE')} AS AMT_BALANCE,
  row_number() OVER (ORDER BY SK_ID_CURR) AS POSITION FROM application""")
def q_row_position(spark, d):
    """PRJ2 / JN5: 1-based row position by key (range partitions + offsets)."""
    app = roles.application(spark, d).select(KEY, "AMT_BALANCE")
    return round_doubles(with_position(app, KEY))


def _sql_sanitize():
    ctes, _ = _prev_sql_parts()
    items = S.share_sql("NAME_PRIORITY", S.ORDER_PRIORITY, "PREV_")
    cols = ",\n  ".join(f"{S.r6(S.q(a))} AS {re.sub(r'[^A-Za-z0-9_]', '_', a)}" for _, a, _ in items)
    return S.with_roles("previous_application", extra=ctes) + f"SELECT SK_ID_CURR,\n  {cols}\nFROM prev_agg"


@register("q_drop_sanitize_names", _sql_sanitize)
def q_drop_sanitize_names(spark, d):
    """PRJ7/PRJ9/PRJ10: drop columns, sanitise names to [A-Za-z0-9_], verify none
    is left with another character."""
    prev = sanitize_columns(fx.previous_applications(spark, d))
    dropped = [c for c in prev.columns if c != KEY and not c.startswith("PREV_NAME_PRIORITY_")]
    out = prev.drop(*dropped)
    bad = find_bad_names(out.columns)
    if bad:
        raise ValueError(f"unsanitised names: {bad}")
    return round_doubles(out)


def _sql_narrow():
    ctes, outs = _app_sql_parts()
    cols = ["CAST(SK_ID_CURR AS INTEGER) AS SK_ID_CURR",
            f"CAST({S.r6('AMT_BALANCE')} AS FLOAT) AS AMT_BALANCE",
            "CAST(NATION_CODE AS INTEGER) AS NATION_CODE",
            "FLAG_POSITIVE_BALANCE = 1 AS FLAG_POSITIVE_BALANCE"]
    cols += [f"{S.q(c)} = 1 AS {S.q(c)}" for c, _ in outs if c.startswith("NAME_SEGMENT_")]
    cols.append(f"CAST({S.r6('BALANCE_PER_NATION')} AS FLOAT) AS BALANCE_PER_NATION")
    cols += ["CAST(SK_ID_CURR AS BIGINT) + 3000000000 AS SK_ID_WIDE", "SK_ID_CURR * CAST('1e300' AS DOUBLE) AS HUGE"]
    return S.with_roles("application", extra=ctes) + "SELECT " + ",\n  ".join(cols) + "\nFROM app_feat"


@register("q_narrow_types", _sql_narrow)
def q_narrow_types(spark, d):
    """PRJ8: key -> int, {0,1} columns -> boolean, double -> float, long -> int; a key
    above int32 and a double above float keep their width."""
    app = round_doubles(fx.application_features(spark, d))
    return narrow_types(app.withColumns({"SK_ID_WIDE": F.col(KEY).cast("long") + 3_000_000_000,
                                         "HUGE": F.col(KEY) * F.lit(1e300)}))


_DOC_FEATURES = ["LANG", "SOURCE", "N_CHARS", "N_SPACE_TOKENS", "N_LINES", "N_DIGITS", "N_UPPER",
                 "N_AT", "N_EXCLAIM", "N_SPACES"]


@register("q_label_split", S.with_roles("documents_entity") + f"""
SELECT CAST(TARGET AS INTEGER) AS TARGET, {', '.join(_DOC_FEATURES)}
FROM documents_entity WHERE TARGET IS NOT NULL""")
def q_label_split(spark, d):
    """PRJ11/PRJ12: labelled rows -> features without key and label, int label."""
    features, label, train, _ = label_split(roles.documents_entity(spark, d))
    return train.select(F.col("TARGET").cast("int").alias("TARGET"), *_DOC_FEATURES)


@register("q_union_missing_cols", S.with_roles("documents_entity") + """
SELECT SK_ID_CURR, TARGET, N_CHARS FROM (
  SELECT SK_ID_CURR, TARGET, N_CHARS FROM documents_entity WHERE TARGET IS NOT NULL
  UNION ALL BY NAME
  SELECT SK_ID_CURR, N_CHARS FROM documents_entity WHERE TARGET IS NULL) u""")
def q_union_missing_cols(spark, d):
    """SET1: labelled and unlabelled parts stacked by name; TARGET NULL where absent."""
    ent = roles.documents_entity(spark, d)
    _, _, train, test = label_split(ent)
    return union_by_name(train.select(KEY, "TARGET", "N_CHARS"), test.select(KEY, "N_CHARS"))


# ---------------------------------------------------------------- encoders
def _fac_sql(col, src):
    return (f"fac_{col} AS (SELECT {col} AS v, CAST(row_number() OVER (ORDER BY min(SK_ID_CURR), {col}) - 1 AS INTEGER)"
            f" AS code FROM {src} WHERE {col} IS NOT NULL GROUP BY {col})")


@register("q_factorize", S.with_roles("application", extra=[
    f"app2 AS (SELECT SK_ID_CURR, {_SEG_NULLED} AS NAME_SEGMENT, FLAG_POSITIVE_BALANCE FROM application)",
    _fac_sql("NAME_SEGMENT", "app2"), _fac_sql("FLAG_POSITIVE_BALANCE", "app2")]) + """
SELECT SK_ID_CURR, CAST(coalesce(a.code, -1) AS INTEGER) AS NAME_SEGMENT,
       CAST(coalesce(b.code, -1) AS INTEGER) AS FLAG_POSITIVE_BALANCE
FROM app2 LEFT JOIN fac_NAME_SEGMENT a ON app2.NAME_SEGMENT = a.v
LEFT JOIN fac_FLAG_POSITIVE_BALANCE b ON app2.FLAG_POSITIVE_BALANCE = b.v""")
def q_factorize(spark, d):
    """ENC1: codes in order of first appearance (by client key); NULL -> -1."""
    app = _app_seg_nulled(spark, d)
    fac = FactorizeSpec.fit(app, ["NAME_SEGMENT", "FLAG_POSITIVE_BALANCE"], order_col=KEY)
    return fac.transform(app).select(KEY, "NAME_SEGMENT", "FLAG_POSITIVE_BALANCE")


@register("q_onehot", S.with_roles("application") + "SELECT SK_ID_CURR,\n  " + ",\n  ".join(
    f"CAST(({_SEG_NULLED} IS NOT DISTINCT FROM '{v}') AS DOUBLE) AS NAME_SEGMENT_{v}"
    for v in S.SEGMENT if v != "HOUSEHOLD") + "\nFROM application")
def q_onehot(spark, d):
    """ENC2/ENC4: one-hot without NULL indicator; a NULL row is all zeros."""
    app = _app_seg_nulled(spark, d).select(KEY, "NAME_SEGMENT")
    spec = OneHotSpec.fit(app, ["NAME_SEGMENT"], nan_column=False)
    return spec.transform(app)


@register("q_onehot_wide", """WITH x AS (SELECT c_custkey, nullif(c_name, (SELECT min(c_name) FROM customer)) AS a, c_mktsegment AS b FROM customer),
a AS (SELECT a AS v, row_number() OVER (ORDER BY a) - 1 AS code FROM (SELECT DISTINCT a FROM x WHERE a IS NOT NULL) s),
n AS (SELECT count(*) AS n FROM a),
b AS (SELECT b AS v, n + row_number() OVER (ORDER BY b) AS code FROM (SELECT DISTINCT b FROM x WHERE b IS NOT NULL) s, n)
SELECT c_custkey, CAST(coalesce(a.code, n.n) AS INTEGER) AS first_code, CAST(b.code AS INTEGER) AS last_code
FROM x LEFT JOIN a ON a.v = x.a JOIN b ON b.v = x.b, n""")
def q_onehot_wide(spark, d):
    """ENC2-ENC4 without a cap on the levels: the customers' names (one made NULL) and segments as sparse codes."""
    c = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    least = c.agg(F.min("c_name").alias("least"))
    c = c.join(least).select("c_custkey", F.nullif("c_name", "least").alias("c_name"), "c_mktsegment")
    codes = SparseOneHot.fit(c, ["c_name", "c_mktsegment"]).transform(c, "c_custkey")
    return codes.select("c_custkey", F.col("codes")[0].alias("first_code"), F.col("codes")[1].alias("last_code"))


@register("q_category_share_wide", f"""SELECT l_suppkey, CAST(l_partkey AS VARCHAR) AS value, count(*) AS n,
  {S.r6('CAST(count(*) AS DOUBLE) / any_value(w)')} AS share
FROM (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS w FROM lineitem) x GROUP BY l_suppkey, l_partkey""")
def q_category_share_wide(spark, d):
    """AGG8 over thousands of categories: the share of each part in the lines of a supplier."""
    li = read_table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    return round_doubles(category_shares(li, "l_suppkey", "l_partkey"))


_RF_NULLED = "NULLIF(RETURN_FLAG, 'N')"


def _onehot_nan_sql():
    cols = [f"CAST((STATUS IS NOT DISTINCT FROM '{v}') AS DOUBLE) AS STATUS_{v}" for v in S.LINE_STATUS]
    cols.append("CAST((STATUS IS NULL) AS DOUBLE) AS STATUS_nan")
    cols += [f"CAST(({_RF_NULLED} IS NOT DISTINCT FROM '{v}') AS DOUBLE) AS RETURN_FLAG_{v}"
             for v in S.RETURN_FLAG if v != "N"]
    cols.append(f"CAST(({_RF_NULLED} IS NULL) AS DOUBLE) AS RETURN_FLAG_nan")
    return (S.with_roles("bureau_balance") + "SELECT SK_ID_BUREAU, MONTHS_BALANCE,\n  "
            + ",\n  ".join(cols) + "\nFROM bureau_balance")


def _bb_flag_nulled(spark, d):
    bb = roles.bureau_balance(spark, d)
    return bb.withColumn("RETURN_FLAG", F.nullif(F.col("RETURN_FLAG"), F.lit("N")))


@register("q_onehot_nan", _onehot_nan_sql)
def q_onehot_nan(spark, d):
    """ENC3: one-hot with a ``_nan`` indicator, present even when constant zero."""
    bb = _bb_flag_nulled(spark, d)
    spec = OneHotSpec.fit(bb, ["STATUS", "RETURN_FLAG"], nan_column=True)
    return spec.transform(bb)


# ---------------------------------------------------------------- single aggregates
_GROUP_SPEC = {"DAYS_CREDIT": ["min", "max", "mean", "var"], "AMT_CREDIT_SUM": ["min", "max", "mean", "sum"]}


def _agg_sql(role, src, key, items, extra_ctes=()):
    return (S.with_roles(role, extra=list(extra_ctes)) + f"SELECT {key},\n  "
            + S.rounded([(a, dbl) for _, a, dbl in items]) + f"\nFROM (SELECT {key},\n  "
            + S.select_list(items) + f"\n  FROM {src} WHERE {key} IS NOT NULL GROUP BY {key}) g")


@register("q_group_aggs", _agg_sql("bureau", "bureau", KEY, S.spec_sql(_GROUP_SPEC, "BURO_", int_cols={"DAYS_CREDIT"})))
def q_group_aggs(spark, d):
    """AGG1/AGG2: config-driven min/max/mean/var/sum with flattened names."""
    return round_doubles(grouped(roles.bureau(spark, d), KEY, _GROUP_SPEC, "BURO_"))


_RECENT = "CASE WHEN DAYS_CREDIT >= -600 THEN AMT_CREDIT_SUM END"


def _bureau_recent(spark, d):
    b = roles.bureau(spark, d)
    return b.withColumn("AMT_RECENT", F.when(F.col("DAYS_CREDIT") >= -600, F.col("AMT_CREDIT_SUM")))


_RECENT_CTE = f"bureau_r AS (SELECT *, {_RECENT} AS AMT_RECENT FROM bureau)"


@register("q_sum_allnull", _agg_sql("bureau", "bureau_r", KEY,
                                    S.spec_sql({"AMT_RECENT": ["sum", "mean", "min"]})
                                    + [("count(AMT_RECENT)", "AMT_RECENT_COUNT", False)], [_RECENT_CTE]))
def q_sum_allnull(spark, d):
    """AGG3: sum over a group whose values are all NULL is 0 (mean stays NULL)."""
    b = _bureau_recent(spark, d)
    return round_doubles(grouped(b, KEY, {"AMT_RECENT": ["sum", "mean", "min"]},
                                 extra=[F.count("AMT_RECENT").alias("AMT_RECENT_COUNT")]))


@register("q_var_single", _agg_sql("bureau_balance", "bureau_balance", "SK_ID_BUREAU",
                                   S.spec_sql({"MONTHS_BALANCE": ["var", "size"]}, int_cols={"MONTHS_BALANCE"})))
def q_var_single(spark, d):
    """AGG4: sample variance; a one-row group gives NULL."""
    return round_doubles(grouped(roles.bureau_balance(spark, d), "SK_ID_BUREAU",
                                 {"MONTHS_BALANCE": ["var", "size"]}))


@register("q_group_size", _agg_sql("bureau", "bureau_r", KEY,
                                   S.spec_sql({"AMT_RECENT": ["size"]})
                                   + [("count(AMT_RECENT)", "AMT_RECENT_COUNT", False)], [_RECENT_CTE]))
def q_group_size(spark, d):
    """AGG5: group size counts NULL rows too (unlike count(col))."""
    b = _bureau_recent(spark, d)
    return grouped(b, KEY, {"AMT_RECENT": ["size"]}, extra=[F.count("AMT_RECENT").alias("AMT_RECENT_COUNT")])


_SUBSET_SPEC = {"DAYS_CREDIT": ["min", "max", "mean"], "AMT_RECENT": ["sum", "mean", "max"],
                "AMT_CREDIT_SUM": ["sum", "var"]}


def _subset_sql():
    ints = {"DAYS_CREDIT"}
    items = (S.spec_sql(_SUBSET_SPEC, "BURO_", int_cols=ints)
             + S.spec_sql(_SUBSET_SPEC, "ACTIVE_", "CREDIT_ACTIVE IS NOT DISTINCT FROM 'O'", ints)
             + S.spec_sql(_SUBSET_SPEC, "CLOSED_", "CREDIT_ACTIVE IS NOT DISTINCT FROM 'F'", ints))
    return _agg_sql("bureau", "bureau_r", KEY, items, [_RECENT_CTE])


@register("q_subset_aggs", _subset_sql)
def q_subset_aggs(spark, d):
    """AGG6/PRJ13/JN3: subset aggregates beside the total in ONE pass; a client with
    no subset row is NULL in every subset column (sums included)."""
    b = _bureau_recent(spark, d)
    st = F.col("CREDIT_ACTIVE")
    return round_doubles(grouped(b, KEY, _SUBSET_SPEC, "BURO_", subsets=[
        Subset("ACTIVE_", st.eqNullSafe(F.lit(roles.ACTIVE))),
        Subset("CLOSED_", st.eqNullSafe(F.lit(roles.CLOSED)))]))


@register("q_nunique", _agg_sql("installments", "installments", KEY,
                                S.spec_sql({"NUM_INSTALMENT_VERSION": ["nunique"], "PAYMENT_FLAG": ["nunique"]})))
def q_nunique(spark, d):
    """AGG7: distinct non-null count per group."""
    return grouped(roles.installments(spark, d), KEY,
                   {"NUM_INSTALMENT_VERSION": ["nunique"], "PAYMENT_FLAG": ["nunique"]})


@register("q_category_share", _agg_sql(
    "bureau_balance", "bb2", "SK_ID_BUREAU",
    S.share_sql("STATUS", S.LINE_STATUS) + S.share_sql("RETURN_FLAG", [v for v in S.RETURN_FLAG if v != "N"]),
    [f"bb2 AS (SELECT SK_ID_BUREAU, STATUS, {_RF_NULLED} AS RETURN_FLAG FROM bureau_balance)"]))
def q_category_share(spark, d):
    """AGG8: share of each category over all rows of the group (NULL rows count in
    the denominator), computed without materialising dummy columns."""
    bb = _bb_flag_nulled(spark, d)
    cats = OneHotSpec.fit(bb, ["STATUS", "RETURN_FLAG"])
    shares = [e for c, vals in cats.categories.items() for e in category_share_exprs(c, vals)]
    return round_doubles(bb.where(F.col("SK_ID_BUREAU").isNotNull()).groupBy("SK_ID_BUREAU").agg(*shares))
