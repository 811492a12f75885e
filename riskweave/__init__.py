"""riskweave — a Spark-native credit-risk feature, selection, training and scoring engine.

Sub-packages:

* ``sources``   — scans, sinks and model-bundle persistence
* ``functions`` — small column-expression helpers (null-safe, ratios, hashing, rounding)
* ``operators`` — encoders, config-driven aggregates, profiling, correlation,
  sampling, metrics, explanations and scoring, each a DataFrame -> DataFrame op
* ``learn``     — Spark ML training, tuning, cross-validation and refits
* ``plans``     — the role mapping onto the given tables and the registered queries
* ``streaming`` — Structured Streaming scoring
"""

__version__ = "0.1.0"
