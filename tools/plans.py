"""Write docs/PLANS.md: for each headline query, the physical-plan facts that
matter at scale (exchanges, join strategies, pushed filters, Python stages) and
the formatted plan of the final executed query.

    python tools/plans.py [--sf DIR]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from riskweave.plans import catalog  # noqa: E402
from riskweave.session import get_spark  # noqa: E402

FACTS = {
    "shuffle exchanges": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition",
    "broadcast exchanges": r"BroadcastExchange",
    "sort-merge joins": r"SortMergeJoin",
    "broadcast hash joins": r"BroadcastHashJoin",
    "hash aggregates": r"HashAggregate\(",
    "windows": r"\bWindow \[",
    "python stages": r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas",
    "parquet scans": r"FileScan parquet|Scan parquet",
}


SCALE_NOTE = """## Wide table with broadcasts disabled (the plan at scale)

With `spark.sql.autoBroadcastJoinThreshold=-1` (what the sizes force at 100 TB) the
wide table runs with 9 hash exchanges and 5 sort-merge joins, and no join re-shuffles
a side that is already partitioned:

* lineitem → per-order aggregate (1 exchange), orders on the order key (1), joined.
  The bureau + previous-application client aggregate follows (1).
* events → fused POS + credit-card client aggregate (1).
* installments: lineitem and orders on the order key (2). The single distinct
  aggregate is planned as a (client, version) pre-aggregation (1), so no `Expand`
  is needed and a hot client is spread over its version values. Then per client (1).
* the client table is shuffled once on `SK_ID_CURR` (1). The three client-level
  sort-merge joins reuse that partitioning and the aggregates' own output
  partitioning, so there is no further exchange.
""".split("\n")


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    a = ap.parse_args()
    spark = get_spark("local[8]", 16)
    catalog.load_all()
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/plans.py` on `{a.sf}` (AQE on; the plan shown is the",
           "initial physical plan, before AQE re-plans joins from runtime sizes).", ""]
    for name in HEADLINE:
        df = catalog.QUERIES[name](spark, a.sf)
        if name == "q_corr_gram":  # the result is checkpointed: show the plan that computes it
            from riskweave.operators.correlate import numeric_columns, pairwise_corr
            from riskweave.plans import features as fx
            w = fx.wide_table(spark, a.sf)
            df = pairwise_corr(w, numeric_columns(w, exclude=["SK_ID_CURR"]), materialize=False)
        plan = df._jdf.queryExecution().executedPlan().toString()
        out += [f"## {name}", "", "| fact | count |", "|---|---|"]
        for k, pat in FACTS.items():
            out.append(f"| {k} | {len(re.findall(pat, plan))} |")
        pushed = sorted(set(re.findall(r"PushedFilters: \[[^\]]*\]", plan)))
        schemas = sorted(set(re.findall(r"ReadSchema: struct<[^\n]*", plan)))
        out += ["", "Pushed filters: " + ("; ".join(pushed) if pushed else "none"), "",
                "Read schemas:", ""] + [f"* `{s[:160]}`" for s in schemas] + [""]
    out += SCALE_NOTE
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md"), "w") as f:
        f.write("\n".join(out) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
