"""Small inputs with the awkward rows that every operator must take."""

import duckdb
import pyarrow.parquet as pq

SMALL = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def docs(spark, texts, extra=True):
    """A documents table with the given (doc_id, text) rows and columns whose names clash with operators'."""
    rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), -1, None, "x") for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rank long, kept boolean, length string"
    return spark.createDataFrame(rows, schema) if extra else spark.createDataFrame([r[:5] for r in rows], schema.split(", rank")[0])


def table_rows(name, sf=SMALL):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def sql_rows(sql, sf=SMALL):
    c = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    r = c.sql(sql)
    return sorted(map(tuple, r.fetchall()), key=repr), r.columns


def same(df, sql, sf=SMALL):
    want, columns = sql_rows(sql, sf)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == want


def partition(pairs, nodes):
    """Smallest reachable node by brute force."""
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low
