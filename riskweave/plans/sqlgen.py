"""SQL text for the DuckDB oracles: role views and aggregate expressions written
independently of the Spark builders (ANSI SQL plus DuckDB's date/json functions)."""

from __future__ import annotations

# Category lists of the given tables (what the Spark side fits).
ORDER_STATUS = ["F", "O", "P"]
ORDER_PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
RETURN_FLAG = ["A", "N", "R"]
LINE_STATUS = ["F", "O"]
EVENT_TYPE = ["click", "error", "purchase", "signup", "view"]
SEGMENT = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
LANG = ["de", "en", "es", "fr"]
SOURCE = sorted(f"src{i}" for i in range(20))


def days(col: str, ref: str = "2002-01-01") -> str:
    return f"CAST(datediff('day', DATE '{ref}', CAST({col} AS DATE)) AS INTEGER)"


ROLE_CTES = {
    "application": f"""application AS (
  SELECT c_custkey AS SK_ID_CURR, c_mktsegment AS NAME_SEGMENT,
         CASE WHEN c_acctbal >= 0 THEN 'Y' ELSE 'N' END AS FLAG_POSITIVE_BALANCE,
         c_acctbal / 1000 AS AMT_BALANCE, c_nationkey AS NATION_CODE
  FROM customer)""",
    "bureau": f"""bureau AS (
  SELECT o_orderkey AS SK_ID_BUREAU, o_custkey AS SK_ID_CURR, o_orderstatus AS CREDIT_ACTIVE,
         o_orderpriority AS CREDIT_TYPE, o_totalprice / 1000 AS AMT_CREDIT_SUM,
         {days('o_orderdate')} AS DAYS_CREDIT
  FROM orders)""",
    "bureau_balance": """bureau_balance AS (
  SELECT l_orderkey AS SK_ID_BUREAU, l_linenumber AS MONTHS_BALANCE, l_linestatus AS STATUS,
         l_returnflag AS RETURN_FLAG
  FROM lineitem)""",
    "previous_application": f"""prev_lines AS (
  SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) / 1000 AS AMT_CREDIT,
         sum(l_extendedprice) / 1000 AS AMT_GOODS_PRICE, count(*) AS CNT_PAYMENT,
         min(l_shipdate) AS first_ship
  FROM lineitem GROUP BY l_orderkey),
previous_application AS (
  SELECT o_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR, o_orderstatus AS NAME_CONTRACT_STATUS,
         o_orderpriority AS NAME_PRIORITY, o_totalprice / 1000 AS AMT_APPLICATION,
         AMT_CREDIT, AMT_GOODS_PRICE, CNT_PAYMENT,
         {days('o_orderdate')} AS DAYS_DECISION, {days('first_ship')} AS DAYS_FIRST_DUE
  FROM orders LEFT JOIN prev_lines ON o_orderkey = l_orderkey)""",
    "pos_cash": f"""pos_cash AS (
  SELECT user_id AS SK_ID_CURR, {days('ts', '2024-02-01')} AS MONTHS_BALANCE, value AS SK_DPD,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS SK_DPD_DEF,
         event_type AS NAME_CONTRACT_STATUS
  FROM events)""",
    "credit_card": f"""credit_card AS (
  SELECT event_id AS SK_ID_PREV, user_id AS SK_ID_CURR, {days('ts', '2024-02-01')} AS MONTHS_BALANCE,
         value AS AMT_BALANCE, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS CNT_DRAWINGS,
         event_type AS NAME_CONTRACT_STATUS
  FROM events)""",
    "installments": f"""installments AS (
  SELECT o_custkey AS SK_ID_CURR, l_linenumber AS NUM_INSTALMENT_VERSION,
         l_extendedprice / 1000 AS AMT_INSTALMENT,
         l_extendedprice * (1 - l_discount) / 1000 AS AMT_PAYMENT,
         {days('o_orderdate')} AS DAYS_INSTALMENT, {days('l_shipdate')} AS DAYS_ENTRY_PAYMENT,
         l_returnflag AS PAYMENT_FLAG
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "documents_entity": """documents_entity AS (
  SELECT d.doc_id AS SK_ID_CURR, l.toxic AS TARGET, lang AS LANG, source AS SOURCE,
         CAST(n_chars AS DOUBLE) AS N_CHARS,
         CAST(len(string_split(text, ' ')) AS DOUBLE) AS N_SPACE_TOKENS,
         CAST(len(string_split(text, chr(10))) AS DOUBLE) AS N_LINES,
         CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS DOUBLE) AS N_DIGITS,
         CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS DOUBLE) AS N_UPPER,
         CAST(length(regexp_replace(text, '[^@]', '', 'g')) AS DOUBLE) AS N_AT,
         CAST(length(regexp_replace(text, '[^!?]', '', 'g')) AS DOUBLE) AS N_EXCLAIM,
         CAST(length(regexp_replace(text, '[^ ]', '', 'g')) AS DOUBLE) AS N_SPACES
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
}


def with_roles(*names: str, extra: list[str] | None = None) -> str:
    parts = [ROLE_CTES[n] for n in names] + list(extra or [])
    return "WITH " + ",\n".join(parts) + "\n"


def agg(fn: str, x: str, flag: str | None = None, int_sum: bool = False) -> str:
    """Aggregate with pandas semantics, as SQL text."""
    v = x if flag is None else f"CASE WHEN {flag} THEN {x} END"
    if fn == "min":
        return f"min({v})"
    if fn == "max":
        return f"max({v})"
    if fn == "mean":
        return f"avg({v})"
    if fn == "var":
        return f"var_samp({v})"
    if fn == "nunique":
        return f"count(DISTINCT {v})"
    if fn == "sum":
        s = f"coalesce(sum({v}), 0)"
        if int_sum:
            s = f"CAST({s} AS BIGINT)"
        return s if flag is None else f"CASE WHEN count(CASE WHEN {flag} THEN 1 END) > 0 THEN {s} END"
    if fn == "size":
        if flag is None:
            return "count(*)"
        return f"CASE WHEN count(CASE WHEN {flag} THEN 1 END) > 0 THEN count(CASE WHEN {flag} THEN 1 END) END"
    raise ValueError(fn)


def spec_sql(spec: dict, prefix: str = "", flag: str | None = None, int_cols=()) -> list[tuple[str, str, bool]]:
    """[(sql expr, alias, is_double)] for a {col: [aggs]} spec; ``int_cols`` are the
    integer-typed inputs (their min/max/sum stay integers)."""
    out = []
    for c, fns in spec.items():
        for fn in fns:
            is_int = fn in ("size", "nunique") or (fn in ("min", "max", "sum") and c in int_cols)
            out.append((agg(fn, c, flag, int_sum=c in int_cols), f"{prefix}{c}_{fn.upper()}", not is_int))
    return out


def share_sql(col: str, values, prefix: str = "", nan: bool = True) -> list[tuple[str, str, bool]]:
    out = [(f"avg(CAST(({col} IS NOT DISTINCT FROM '{v}') AS DOUBLE))", f"{prefix}{col}_{v}_MEAN", True)
           for v in values]
    if nan:
        out.append((f"avg(CAST(({col} IS NULL) AS DOUBLE))", f"{prefix}{col}_nan_MEAN", True))
    return out


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def select_list(items) -> str:
    return ",\n  ".join(f"{it[0]} AS {q(it[1])}" for it in items)


def r6(expr: str, digits: int = 6) -> str:
    """The fixed rounding used by every registered query (same bits as Spark)."""
    s = f"1e{digits}"
    return f"(round(({expr}) * {s} - CAST(0.3767 AS DOUBLE)) / {s} + 0.0)"


def rounded(items, digits: int = 6) -> str:
    """Final projection: ``items`` are (name, is_double); doubles get the fixed rounding."""
    return ",\n  ".join(f"{r6(q(c), digits)} AS {q(c)}" if dbl else q(c) for c, dbl in items)


def outputs(items) -> list[tuple[str, bool]]:
    return [(it[1], it[2]) for it in items]


def positions_cte(name: str, cols: list[str]) -> str:
    vals = ", ".join(f"('{c}', {k})" for k, c in enumerate(cols))
    return f"{name}(col, pos) AS (VALUES {vals})"


def pairs_ctes(src: str, key: str, cols: list[str], tag: str = "p", where: str | None = None) -> list[str]:
    """Pairwise-complete correlation as SQL: unpivot (NULLs dropped) -> self-join on
    the row key -> corr per column pair. Produces CTE ``{tag}_pairs`` with
    (pos_i, pos_j, col_i, col_j, n, r) for pos_i < pos_j; r is raw (NaN -> NULL)."""
    casted = ", ".join(f"CAST({q(c)} AS DOUBLE) AS {q(c)}" for c in cols)
    w = f" WHERE {where}" if where else ""
    return [
        f"{tag}_src AS (SELECT {key}, {casted} FROM {src}{w})",
        positions_cte(f"{tag}_pos", cols),
        f"{tag}_long AS (SELECT u.{key}, u.col, u.val, ps.pos FROM "
        f"(UNPIVOT {tag}_src ON COLUMNS(* EXCLUDE ({key})) INTO NAME col VALUE val) u "
        f"JOIN {tag}_pos ps ON u.col = ps.col)",
        f"{tag}_pairs AS (SELECT a.pos AS pos_i, b.pos AS pos_j, a.col AS col_i, b.col AS col_j,\n"
        f"  count(*) AS n, CASE WHEN isnan(corr(a.val, b.val)) THEN NULL ELSE corr(a.val, b.val) END AS r\n"
        f"  FROM {tag}_long a JOIN {tag}_long b ON a.{key} = b.{key} AND a.pos < b.pos\n"
        f"  GROUP BY a.pos, b.pos, a.col, b.col)",
    ]


def hash_sql(key: str, seed: int) -> str:
    return (f"(CAST(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8)) AS BIGINT) AS DOUBLE)"
            f" / CAST(4294967296 AS DOUBLE))")
