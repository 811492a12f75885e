"""DataFrame operators. Each takes and returns DataFrames (or small fitted specs)."""
