from riskweave.functions.scalar import (  # noqa: F401
    hash_unit, null_safe_ne, positive_part, ratio, round_doubles, round_fixed,
    sanitize_name, sanitize_columns, sentinel_to_null, days_between, find_bad_names,
)
