"""Feature pipelines per source and the assembled wide table (one row per client).

Every source is ONE grouped aggregate keyed by SK_ID_CURR; the two order-level
sources share one per-order lineitem aggregate first. Each source is also usable
alone (the per-source queries). The wide table fuses sources that read the same
table into one client-level groupBy (bureau + previous applications; POS + credit
card). Aggregate outputs are hash-partitioned by SK_ID_CURR, so the left-join chain
onto the client table reuses that partitioning instead of re-shuffling each side.

A client has about as many aggregate columns as values, so the rows are brought together by client before a
client-level aggregate (``together``): what is shuffled are rows, not a buffer of all aggregates for about every row. Clients
holding much of a table are found first and spread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.scalar import positive_part, ratio
from riskweave.operators.aggregate import (
    HOT_ROWS, agg_exprs, all_columns_spec, category_share_exprs, grouped, hot_keys, together,
)
from riskweave.operators.encode import FactorizeSpec, OneHotSpec
from riskweave.plans import roles

KEY = "SK_ID_CURR"

# Aggregation specs (the reference's dictionaries over our role names).
BB_NUM = {"MONTHS_BALANCE": ["min", "max", "size"]}
BUREAU_NUM = {
    "DAYS_CREDIT": ["min", "max", "mean", "var"],
    "AMT_CREDIT_SUM": ["max", "mean", "sum"],
    "MONTHS_BALANCE_MIN": ["min"],
    "MONTHS_BALANCE_MAX": ["max"],
    "MONTHS_BALANCE_SIZE": ["mean", "sum"],
}
PREV_NUM = {
    "AMT_APPLICATION": ["min", "max", "mean"],
    "AMT_CREDIT": ["min", "max", "mean"],
    "APP_CREDIT_PERC": ["min", "max", "mean", "var"],
    "AMT_GOODS_PRICE": ["min", "max", "mean"],
    "DAYS_DECISION": ["min", "max", "mean"],
    "DAYS_FIRST_DUE": ["min", "max", "mean"],
    "CNT_PAYMENT": ["mean", "sum"],
}
POS_NUM = {
    "MONTHS_BALANCE": ["max", "mean", "size"],
    "SK_DPD": ["max", "mean"],
    "SK_DPD_DEF": ["max", "mean"],
}
INSTAL_NUM = {
    "NUM_INSTALMENT_VERSION": ["nunique"],
    "DPD": ["max", "mean", "sum"],
    "DBD": ["max", "mean", "sum"],
    "PAYMENT_PERC": ["max", "mean", "sum", "var"],
    "PAYMENT_DIFF": ["max", "mean", "sum", "var"],
    "AMT_INSTALMENT": ["max", "mean", "sum"],
    "AMT_PAYMENT": ["min", "max", "mean", "sum"],
    "DAYS_ENTRY_PAYMENT": ["max", "mean", "sum"],
}
CC_AGGS = ("min", "max", "mean", "sum", "var")


_SPECS: dict[tuple, OneHotSpec] = {}


def fitted(spark: SparkSession, d: str, name: str, df: DataFrame, cols: list[str],
           nan_column: bool = True, max_levels: int = 1000) -> OneHotSpec:
    """Category fit on a narrow pre-join projection, frozen per application and data
    folder so every plan built from it has the same schema. ``max_levels`` bounds the
    categories of a column (every one becomes a column; beyond, the fit raises)."""
    key = (spark.sparkContext.applicationId, d, name, tuple(cols), nan_column)
    if key not in _SPECS:
        _SPECS[key] = OneHotSpec.fit(df.select(*cols), cols, nan_column=nan_column, max_levels=max_levels)
    return _SPECS[key]


def application_features(spark: SparkSession, d: str, exclude_segment: str | None = None,
                         ieee: bool = False) -> DataFrame:
    """Client table: optional null-safe exclusion, binary factorize, one-hot without
    NULL indicator, ratio feature."""
    app = roles.application(spark, d)
    if exclude_segment is not None:
        app = app.where(~F.col("NAME_SEGMENT").eqNullSafe(F.lit(exclude_segment)))
    fkey = (spark.sparkContext.applicationId, d, f"factorize:{exclude_segment}")
    if fkey not in _SPECS:
        _SPECS[fkey] = FactorizeSpec.fit(app, ["FLAG_POSITIVE_BALANCE"], order_col=KEY)
    fac = _SPECS[fkey]
    onehot = fitted(spark, d, f"application:{exclude_segment}", app, ["NAME_SEGMENT"], nan_column=False)
    app = onehot.transform(fac.transform(app))
    return app.withColumn("BALANCE_PER_NATION", ratio("AMT_BALANCE", "NATION_CODE", ieee))


_HOT: dict[tuple, list] = {}


def hot_clients(spark: SparkSession, d: str, source: str) -> list:
    """The clients with a large part of the orders ("orders") or of the lines of all orders ("lines"), found once per
    application and data folder; tables too small to have one are only counted."""
    key = (spark.sparkContext.applicationId, d, source)
    if key not in _HOT:
        rows = {"orders": roles.bureau, "lines": roles.bureau_balance}[source](spark, d)
        if rows.count() <= HOT_ROWS:
            _HOT[key] = []
        elif source == "lines":
            per_order = rows.groupBy("SK_ID_BUREAU").agg(F.count(F.lit(1)).alias("n"))
            per = roles.bureau(spark, d).select("SK_ID_BUREAU", KEY).join(per_order, "SK_ID_BUREAU").groupBy(KEY).agg(F.sum("n").alias("n"))
            _HOT[key] = hot_keys(per.where(F.col(KEY).isNotNull()), KEY)
        else:
            _HOT[key] = hot_keys(rows.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias("n")), KEY)
    return _HOT[key]


def by_client(spark: SparkSession, d: str, source: str, df: DataFrame, row: tuple[str, ...]) -> DataFrame:
    return together(df.where(F.col(KEY).isNotNull()), KEY, hot_clients(spark, d, source), row)


def _shares(spec: OneHotSpec, prefix: str = "") -> list:
    return [e for c, vals in spec.categories.items() for e in category_share_exprs(c, vals, prefix)]


def per_order_lines(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """ONE aggregate of lineitem per order serving both order-level chains: balance
    stats (min/max/size of MONTHS_BALANCE, status shares) and previous-application
    amounts (credit, goods price, first shipping date)."""
    lines = roles.order_lines(spark, d)
    cats = fitted(spark, d, "bureau_balance", lines, ["STATUS", "RETURN_FLAG"])
    extra = _shares(cats) + [
        (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000).alias("AMT_CREDIT"),
        (F.sum("l_extendedprice") / 1000).alias("AMT_GOODS_PRICE"),
        F.min("l_shipdate").alias("first_ship"),
    ]
    agg = grouped(lines, "SK_ID_BUREAU", BB_NUM, extra=extra)
    return agg, [f"{n}_MEAN" for n in cats.new_columns]


def orders_enriched(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """orders LEFT JOIN the per-order line aggregate (one join for both chains)."""
    per_order, share_names = per_order_lines(spark, d)
    return roles.bureau(spark, d).join(per_order, "SK_ID_BUREAU", "left"), share_names


def bureau_exprs(spark: SparkSession, d: str, bur: DataFrame, bb_share_names: list[str]) -> list:
    """Client-level bureau aggregates: BURO_ totals, category shares, mean of the
    per-bureau balance shares, ACTIVE_ / CLOSED_ subsets."""
    cats = fitted(spark, d, "bureau", roles.bureau(spark, d), ["CREDIT_ACTIVE", "CREDIT_TYPE"])
    status = F.col("CREDIT_ACTIVE")
    return (agg_exprs(BUREAU_NUM, "BURO_") + _shares(cats, "BURO_")
            + agg_exprs({n: ["mean"] for n in bb_share_names}, "BURO_")
            + agg_exprs(BUREAU_NUM, "ACTIVE_", status.eqNullSafe(F.lit(roles.ACTIVE)))
            + agg_exprs(BUREAU_NUM, "CLOSED_", status.eqNullSafe(F.lit(roles.CLOSED))))


def bureau_and_balance(spark: SparkSession, d: str) -> DataFrame:
    """Two-level chain: balance rows -> per bureau row -> per client, with the
    Active/Closed subset aggregates fused into the client-level pass."""
    bur, names = orders_enriched(spark, d)
    bur = by_client(spark, d, "orders", bur, ("SK_ID_BUREAU",))
    return bur.groupBy(KEY).agg(*bureau_exprs(spark, d, bur, names))


def previous_prepared(spark: SparkSession, d: str, sentinel: int = roles.SENTINEL_DAYS,
                      ieee: bool = False, enriched: DataFrame | None = None) -> DataFrame:
    """Previous applications at order grain (SK_ID_PREV = order key)."""
    if enriched is None:
        enriched, _ = orders_enriched(spark, d)
    cols = roles.previous_columns(sentinel, ieee)
    return enriched.select(F.col("SK_ID_BUREAU").alias("SK_ID_PREV"), KEY, "AMT_CREDIT", "AMT_GOODS_PRICE",
                           *[e.alias(c) for c, e in cols.items()])


def previous_exprs(spark: SparkSession, d: str) -> list:
    # same order columns as the bureau fit (renamed): reuse it instead of a second scan
    b = fitted(spark, d, "bureau", roles.bureau(spark, d), ["CREDIT_ACTIVE", "CREDIT_TYPE"])
    cats = OneHotSpec({"NAME_CONTRACT_STATUS": b.categories["CREDIT_ACTIVE"],
                       "NAME_PRIORITY": b.categories["CREDIT_TYPE"]}, nan_column=True)
    status = F.col("NAME_CONTRACT_STATUS")
    return (agg_exprs(PREV_NUM, "PREV_") + _shares(cats, "PREV_")
            + agg_exprs(PREV_NUM, "APPROVED_", status.eqNullSafe(F.lit(roles.APPROVED)))
            + agg_exprs(PREV_NUM, "REFUSED_", status.eqNullSafe(F.lit(roles.REFUSED))))


def previous_applications(spark: SparkSession, d: str, sentinel: int = roles.SENTINEL_DAYS) -> DataFrame:
    prev = previous_prepared(spark, d, sentinel)
    return by_client(spark, d, "orders", prev, ("SK_ID_PREV",)).groupBy(KEY).agg(*previous_exprs(spark, d))


def order_chains(spark: SparkSession, d: str) -> DataFrame:
    """Bureau and previous-application aggregates in ONE client-level groupBy over
    the shared orders-with-lines table (one scan of each table, one shuffle)."""
    bur, names = orders_enriched(spark, d)
    bur = by_client(spark, d, "orders", bur, ("SK_ID_BUREAU",))
    both = bur.select("*", *[e.alias(c) for c, e in roles.previous_columns().items()])
    return both.groupBy(KEY).agg(
        *bureau_exprs(spark, d, bur, names), *previous_exprs(spark, d))


def pos_exprs(spark: SparkSession, d: str) -> list:
    pos = roles.pos_cash(spark, d)
    cats = fitted(spark, d, "events", pos, ["NAME_CONTRACT_STATUS"])
    return agg_exprs(POS_NUM, "POS_") + _shares(cats, "POS_") + [F.count(F.lit(1)).alias("POS_COUNT")]


def pos_cash(spark: SparkSession, d: str) -> DataFrame:
    pos = roles.pos_cash(spark, d)
    return pos.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(*pos_exprs(spark, d))


def installments_prepared(spark: SparkSession, d: str, ieee: bool = False) -> DataFrame:
    ins = roles.installments(spark, d)
    return with_payment_columns(ins, ieee)


def with_payment_columns(ins: DataFrame, ieee: bool = False) -> DataFrame:
    return ins.withColumns({
        "PAYMENT_PERC": ratio("AMT_PAYMENT", "AMT_INSTALMENT", ieee),
        "PAYMENT_DIFF": F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT"),
        "DPD": positive_part(F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")),
        "DBD": positive_part(F.col("DAYS_INSTALMENT") - F.col("DAYS_ENTRY_PAYMENT")),
    })


def installments_payments(spark: SparkSession, d: str) -> DataFrame:
    ins = roles.installments(spark, d)
    ins = with_payment_columns(by_client(spark, d, "lines", ins, tuple(ins.columns)))  # the ratio and differences are not shuffled
    # same lineitem column as the balance fit: reuse it instead of a second scan
    bb = fitted(spark, d, "bureau_balance", roles.order_lines(spark, d), ["STATUS", "RETURN_FLAG"])
    cats = OneHotSpec({"PAYMENT_FLAG": bb.categories["RETURN_FLAG"]}, nan_column=True)
    extra = _shares(cats, "INSTAL_") + [F.count(F.lit(1)).alias("INSTAL_COUNT")]
    return grouped(ins, KEY, INSTAL_NUM, "INSTAL_", extra=extra)


def credit_card_exprs(spark: SparkSession, d: str) -> tuple[DataFrame, list, list]:
    """(rows, aggregates, output columns). The dummies' five aggregates follow from one count
    per category and the group size: they are not materialised, and computed after
    the aggregate."""
    cc = roles.credit_card(spark, d)
    cats = fitted(spark, d, "events", cc, ["NAME_CONTRACT_STATUS"])
    cc = cc.drop("SK_ID_PREV")
    numeric = all_columns_spec(cc.drop("NAME_CONTRACT_STATUS"), exclude=[KEY], fns=CC_AGGS)
    aggs, out = agg_exprs(numeric, "CC_"), [F.col(f"`CC_{c}_{f.upper()}`") for c in numeric for f in CC_AGGS]
    n = F.col("CC_COUNT").cast("double")
    for k, (name, col, value) in enumerate(cats.items()):
        aggs.append(F.count_if(cats.indicator(col, value) == 1).cast("double").alias(f"_cc{k}"))
        c = F.col(f"_cc{k}")
        from_count = {"min": (c == n).cast("double"), "max": (c > 0).cast("double"), "mean": c / n, "sum": c,
                      "var": F.when(n > 1, (c - c * c / n) / (n - 1))}
        out += [from_count[f].alias(f"CC_{name}_{f.upper()}") for f in CC_AGGS]
    return cc, [*aggs, F.count(F.lit(1)).alias("CC_COUNT")], [*out, F.col("CC_COUNT")]


def credit_card_balance(spark: SparkSession, d: str) -> DataFrame:
    """All remaining columns (dummies included) x {min, max, mean, sum, var}."""
    cc, aggs, out = credit_card_exprs(spark, d)
    return cc.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(*aggs).select(KEY, *out)


def event_sources(spark: SparkSession, d: str) -> DataFrame:
    """POS and credit-card aggregates of the events table in ONE groupBy."""
    cc, aggs, out = credit_card_exprs(spark, d)
    cc = cc.withColumns({"SK_DPD": F.col("AMT_BALANCE"), "SK_DPD_DEF": F.col("CNT_DRAWINGS")})
    pos = pos_exprs(spark, d)
    both = cc.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(*pos, *aggs)
    pos_names = [c for c in both.columns if c.startswith("POS_")]
    return both.select(KEY, *[F.col(f"`{c}`") for c in pos_names], *out)


SOURCES = (
    ("bureau", bureau_and_balance),
    ("previous", previous_applications),
    ("pos", pos_cash),
    ("installments", installments_payments),
    ("credit_card", credit_card_balance),
)


def wide_features(spark: SparkSession, d: str, fused: bool = True) -> DataFrame:
    """Client table LEFT JOIN each per-client aggregate (JN1 x5).

    ``fused``: the two order-level chains share one client-level aggregate and the
    two event-level sources another (three shuffles on SK_ID_CURR instead of five);
    the column set and order are the same as the one-source-at-a-time plan."""
    df = application_features(spark, d)
    if not fused:
        for _, fn in SOURCES:
            df = df.join(fn(spark, d), KEY, "left")
        return df
    orders = order_chains(spark, d)
    events = event_sources(spark, d)
    order_cols = [c for c in orders.columns if c != KEY]
    bureau_cols = [c for c in order_cols if c.startswith(("BURO_", "ACTIVE_", "CLOSED_"))]
    prev_cols = [c for c in order_cols if c not in bureau_cols]
    pos_cols = [c for c in events.columns if c.startswith("POS_")]
    cc_cols = [c for c in events.columns if c.startswith("CC_")]
    ins = installments_payments(spark, d)
    app_cols = df.columns
    df = df.join(orders, KEY, "left").join(events, KEY, "left").join(ins, KEY, "left")
    ins_cols = [c for c in ins.columns if c != KEY]
    return df.select(*app_cols, *bureau_cols, *prev_cols, *pos_cols, *ins_cols, *cc_cols)


_WIDE_TABLES: dict[tuple, str] = {}


def wide_table(spark: SparkSession, d: str) -> DataFrame:
    """The wide table written once per application to the shared checkpoint folder
    (the reference's ``all_data`` parquet) and read back: feature selection reads a
    materialised table instead of re-running the five pipelines per report."""
    from riskweave.session import scratch_path
    from riskweave.sources.tables import write_parquet
    key = (spark.sparkContext.applicationId, d)
    if key not in _WIDE_TABLES:
        _WIDE_TABLES[key] = write_parquet(wide_features(spark, d), scratch_path(spark, "all-data"))
    return spark.read.parquet(_WIDE_TABLES[key])
