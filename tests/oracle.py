"""Compare queries with their SQL in DuckDB on the same tables."""

import os


def compare(spark, sf_dir, query, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)

    def rows(frame):
        frame = frame[columns].astype(object)
        return sorted(frame.where(frame.notna(), None).astype(str).itertuples(index=False, name=None))

    assert rows(got) == rows(want)
    return len(got)
