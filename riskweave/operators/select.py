"""End-to-end feature selection as a fitted spec (SEL1 + SEL4-SEL7): missing-rate cut,
signed order-dependent collinearity cut, top-k positive and negative label
correlations intersected with the survivors. Fitting returns column names only
(metadata); ``transform`` is a plain projection, so the same cut applies to the
labelled and the unlabelled parts (SEL6)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.correlate import (
    collinear_drop, numeric_columns, pairwise_corr, split_label, topk_features,
)
from riskweave.operators.profile import missing_cut


@dataclass(frozen=True)
class SelectionSpec:
    keep: tuple[str, ...]
    missing_dropped: tuple[str, ...]
    collinear_dropped: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[c for c in df.columns if c in set(self.keep)])


def fit_selection(df: DataFrame, label: str, key: str, missing_threshold: float = 75.0,
                  collinear_threshold: float = 0.8, k: int = 100,
                  fit_on: Column | None = None) -> SelectionSpec:
    """``fit_on`` restricts the rows all cuts are fitted on (default: every
    labelled row, as the reference does; pass e.g. ``F.col('split') == 'train'``
    to fit on the training part only)."""
    rows = df.where(F.col(label).isNotNull())
    if fit_on is not None:
        rows = rows.where(fit_on)
    rows, missing = missing_cut(rows, missing_threshold, protect=[key, label])
    feats = numeric_columns(rows, exclude=[key, label])
    pairs = pairwise_corr(rows, [label, *feats])  # one pass: features with each other and with the label
    between, with_label = split_label(pairs)
    removed = {r["feature"] for r in collinear_drop(between, collinear_threshold).collect()}
    chosen = {r["feature"] for r in topk_features(with_label, k).collect()}
    keep = [c for c in rows.columns if c in (chosen - removed) or c in (key, label)]
    return SelectionSpec(tuple(keep), tuple(missing), tuple(sorted(removed)))
