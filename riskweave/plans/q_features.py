"""Registered queries: scans, cleaning, encoding, aggregates, joins (feature side)."""

from __future__ import annotations

from riskweave.functions.scalar import round_doubles
from riskweave.plans import features as fx
from riskweave.plans import roles
from riskweave.plans import sqlgen as S
from riskweave.plans.catalog import register

KEY = "SK_ID_CURR"


# ---------------------------------------------------------------- bureau chain (flagship)
def _bureau_sql_parts():
    bb_items = (S.spec_sql(fx.BB_NUM, int_cols={"MONTHS_BALANCE"})
                + S.share_sql("STATUS", S.LINE_STATUS) + S.share_sql("RETURN_FLAG", S.RETURN_FLAG))
    bb_share_names = [a for _, a, _ in bb_items if a.startswith(("STATUS_", "RETURN_FLAG_"))]
    ctes = [
        f"bb_agg AS (SELECT SK_ID_BUREAU,\n  {S.select_list(bb_items)}\n"
        f"  FROM bureau_balance WHERE SK_ID_BUREAU IS NOT NULL GROUP BY SK_ID_BUREAU)",
        "bur AS (SELECT * FROM bureau LEFT JOIN bb_agg USING (SK_ID_BUREAU))",
    ]
    ints = {"DAYS_CREDIT", "MONTHS_BALANCE_MIN", "MONTHS_BALANCE_MAX", "MONTHS_BALANCE_SIZE"}
    items = (S.spec_sql(fx.BUREAU_NUM, "BURO_", int_cols=ints)
             + S.share_sql("CREDIT_ACTIVE", S.ORDER_STATUS, "BURO_")
             + S.share_sql("CREDIT_TYPE", S.ORDER_PRIORITY, "BURO_")
             + S.spec_sql({n: ["mean"] for n in bb_share_names}, "BURO_")
             + S.spec_sql(fx.BUREAU_NUM, "ACTIVE_", "CREDIT_ACTIVE IS NOT DISTINCT FROM 'O'", ints)
             + S.spec_sql(fx.BUREAU_NUM, "CLOSED_", "CREDIT_ACTIVE IS NOT DISTINCT FROM 'F'", ints))
    ctes.append(f"bureau_agg AS (SELECT SK_ID_CURR,\n  {S.select_list(items)}\n"
                f"  FROM bur WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR)")
    return ctes, S.outputs(items)


def _sql_bureau_two_level():
    ctes, outs = _bureau_sql_parts()
    return (S.with_roles("application", "bureau", "bureau_balance", extra=ctes)
            + f"SELECT SK_ID_CURR,\n  {S.rounded(outs)}\nFROM application LEFT JOIN bureau_agg USING (SK_ID_CURR)")


@register("q_bureau_two_level", _sql_bureau_two_level)
def q_bureau_two_level(spark, d):
    """Flagship: client LEFT JOIN (orders LEFT JOIN per-order lineitem aggregate)
    aggregated per client, with Active/Closed subsets (AGG1-10, JN1-2, ENC3)."""
    app = roles.application(spark, d).select(KEY)
    return round_doubles(app.join(fx.bureau_and_balance(spark, d), KEY, "left"))


# ---------------------------------------------------------------- other sources
def _prev_sql_parts():
    prep = ("prev_prep AS (SELECT SK_ID_PREV, SK_ID_CURR, NAME_CONTRACT_STATUS, NAME_PRIORITY,\n"
            "  AMT_APPLICATION, AMT_CREDIT, AMT_GOODS_PRICE, CNT_PAYMENT,\n"
            f"  NULLIF(DAYS_DECISION, {roles.SENTINEL_DAYS}) AS DAYS_DECISION,\n"
            f"  NULLIF(DAYS_FIRST_DUE, {roles.SENTINEL_DAYS}) AS DAYS_FIRST_DUE,\n"
            "  AMT_APPLICATION / NULLIF(AMT_CREDIT, 0) AS APP_CREDIT_PERC\n"
            "  FROM previous_application)")
    ints = {"DAYS_DECISION", "DAYS_FIRST_DUE", "CNT_PAYMENT"}
    items = (S.spec_sql(fx.PREV_NUM, "PREV_", int_cols=ints)
             + S.share_sql("NAME_CONTRACT_STATUS", S.ORDER_STATUS, "PREV_")
             + S.share_sql("NAME_PRIORITY", S.ORDER_PRIORITY, "PREV_")
             + S.spec_sql(fx.PREV_NUM, "APPROVED_", "NAME_CONTRACT_STATUS IS NOT DISTINCT FROM 'F'", ints)
             + S.spec_sql(fx.PREV_NUM, "REFUSED_", "NAME_CONTRACT_STATUS IS NOT DISTINCT FROM 'P'", ints))
    agg = (f"prev_agg AS (SELECT SK_ID_CURR,\n  {S.select_list(items)}\n"
           "  FROM prev_prep WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR)")
    return [prep, agg], S.outputs(items)


def _pos_sql_parts():
    items = (S.spec_sql(fx.POS_NUM, "POS_", int_cols={"MONTHS_BALANCE"})
             + S.share_sql("NAME_CONTRACT_STATUS", S.EVENT_TYPE, "POS_")
             + [("count(*)", "POS_COUNT", False)])
    agg = (f"pos_agg AS (SELECT SK_ID_CURR,\n  {S.select_list(items)}\n"
           "  FROM pos_cash WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR)")
    return [agg], S.outputs(items)


def _ins_sql_parts():
    prep = ("ins_prep AS (SELECT *, AMT_PAYMENT / NULLIF(AMT_INSTALMENT, 0) AS PAYMENT_PERC,\n"
            "  AMT_INSTALMENT - AMT_PAYMENT AS PAYMENT_DIFF,\n"
            "  CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT > 0 THEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT ELSE 0 END AS DPD,\n"
            "  CASE WHEN DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT > 0 THEN DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT ELSE 0 END AS DBD\n"
            "  FROM installments)")
    ints = {"NUM_INSTALMENT_VERSION", "DPD", "DBD", "DAYS_ENTRY_PAYMENT"}
    items = (S.spec_sql(fx.INSTAL_NUM, "INSTAL_", int_cols=ints)
             + S.share_sql("PAYMENT_FLAG", S.RETURN_FLAG, "INSTAL_")
             + [("count(*)", "INSTAL_COUNT", False)])
    agg = (f"ins_agg AS (SELECT SK_ID_CURR,\n  {S.select_list(items)}\n"
           "  FROM ins_prep WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR)")
    return [prep, agg], S.outputs(items)


def _cc_sql_parts():
    dummies = [(f"CAST((NAME_CONTRACT_STATUS IS NOT DISTINCT FROM '{v}') AS DOUBLE)",
                f"NAME_CONTRACT_STATUS_{v}") for v in S.EVENT_TYPE]
    dummies.append(("CAST((NAME_CONTRACT_STATUS IS NULL) AS DOUBLE)", "NAME_CONTRACT_STATUS_nan"))
    prep = (f"cc_prep AS (SELECT SK_ID_CURR, MONTHS_BALANCE, AMT_BALANCE, CNT_DRAWINGS,\n  "
            f"{S.select_list(dummies)}\n  FROM credit_card)")
    spec = {c: list(fx.CC_AGGS) for c in ["MONTHS_BALANCE", "AMT_BALANCE", "CNT_DRAWINGS"] + [a for _, a in dummies]}
    items = S.spec_sql(spec, "CC_", int_cols={"MONTHS_BALANCE"}) + [("count(*)", "CC_COUNT", False)]
    agg = (f"cc_agg AS (SELECT SK_ID_CURR,\n  {S.select_list(items)}\n"
           "  FROM cc_prep WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR)")
    return [prep, agg], S.outputs(items)


def _app_sql_parts():
    fac = ("fac AS (SELECT FLAG_POSITIVE_BALANCE AS v,\n"
           "  CAST(row_number() OVER (ORDER BY min(SK_ID_CURR), FLAG_POSITIVE_BALANCE) - 1 AS INTEGER) AS code\n"
           "  FROM application WHERE FLAG_POSITIVE_BALANCE IS NOT NULL GROUP BY FLAG_POSITIVE_BALANCE)")
    onehot = [(f"CAST((NAME_SEGMENT IS NOT DISTINCT FROM '{v}') AS DOUBLE)", f"NAME_SEGMENT_{v}", True)
              for v in S.SEGMENT]
    feat = ("app_feat AS (SELECT SK_ID_CURR,\n"
            "  CAST(coalesce(fac.code, -1) AS INTEGER) AS FLAG_POSITIVE_BALANCE, AMT_BALANCE, NATION_CODE,\n"
            f"  {S.select_list(onehot)},\n"
            "  AMT_BALANCE / NULLIF(NATION_CODE, 0) AS BALANCE_PER_NATION\n"
            "  FROM application LEFT JOIN fac ON FLAG_POSITIVE_BALANCE = fac.v)")
    outs = ([("FLAG_POSITIVE_BALANCE", False), ("AMT_BALANCE", True), ("NATION_CODE", False)]
            + [(a, True) for _, a, _ in onehot] + [("BALANCE_PER_NATION", True)])
    return [fac, feat], outs


def _source_sql(role_names, parts_fn, agg_name):
    ctes, outs = parts_fn()
    return (S.with_roles(*role_names, extra=ctes)
            + f"SELECT SK_ID_CURR,\n  {S.rounded(outs)}\nFROM {agg_name}")


@register("q_previous", lambda: _source_sql(["previous_application"], _prev_sql_parts, "prev_agg"))
def q_previous(spark, d):
    """Previous applications: sentinel -> NULL, ratio, one-hot shares, Approved/Refused."""
    return round_doubles(fx.previous_applications(spark, d))


@register("q_pos", lambda: _source_sql(["pos_cash"], _pos_sql_parts, "pos_agg"))
def q_pos(spark, d):
    """POS balance: min/max/mean/size, category shares, POS_COUNT (JN4 as one agg)."""
    return round_doubles(fx.pos_cash(spark, d))


@register("q_installments", lambda: _source_sql(["installments"], _ins_sql_parts, "ins_agg"))
def q_installments(spark, d):
    """Installments: fact-fact join, ratio/difference/positive-part features, nunique."""
    return round_doubles(fx.installments_payments(spark, d))


@register("q_credit_all_aggs", lambda: _source_sql(["credit_card"], _cc_sql_parts, "cc_agg"))
def q_credit_all_aggs(spark, d):
    """Credit card: every remaining column x {min,max,mean,sum,var} (AGG11) + CC_COUNT."""
    return round_doubles(fx.credit_card_balance(spark, d))


@register("q_app_features", lambda: S.with_roles("application", extra=_app_sql_parts()[0])
          + f"SELECT SK_ID_CURR,\n  {S.rounded(_app_sql_parts()[1])}\nFROM app_feat")
def q_app_features(spark, d):
    """Client table: factorize, one-hot without NULL indicator, ratio."""
    return round_doubles(fx.application_features(spark, d))


def wide_sql_parts():
    """(CTE list ending with ``wide`` — unrounded, doubles cast — , ordered outputs)."""
    ctes, outs = [], []
    for fn in (_app_sql_parts, _bureau_sql_parts, _prev_sql_parts, _pos_sql_parts, _ins_sql_parts, _cc_sql_parts):
        c, o = fn()
        ctes += c
        outs += o
    joins = "".join(f"\nLEFT JOIN {t} USING (SK_ID_CURR)"
                    for t in ("bureau_agg", "prev_agg", "pos_agg", "ins_agg", "cc_agg"))
    ctes.append("wide AS (SELECT SK_ID_CURR,\n  " + ",\n  ".join(S.q(c) for c, _ in outs)
                + "\nFROM app_feat" + joins + ")")
    return ctes, outs


WIDE_ROLES = ("application", "bureau", "bureau_balance", "previous_application",
              "pos_cash", "installments", "credit_card")


def _sql_wide():
    ctes, outs = wide_sql_parts()
    return S.with_roles(*WIDE_ROLES, extra=ctes) + "SELECT SK_ID_CURR,\n  " + S.rounded(outs) + "\nFROM wide"


@register("q_wide_features", _sql_wide)
def q_wide_features(spark, d):
    """The assembled wide table: client LEFT JOIN five per-client aggregates (JN1 x5)."""
    return round_doubles(fx.wide_features(spark, d))
