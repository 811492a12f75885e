from riskweave.sources.tables import (  # noqa: F401
    TABLES, read_table, read_csv, write_csv, write_parquet, head_rows,
    head_of_files, in_file_order, read_csv_checked, with_file_position,
)
