"""Runs a query in Spark and its SQL in DuckDB, and compares the rows."""

from __future__ import annotations

from pathlib import Path

import duckdb


def differences(spark, tmp: Path, sf_dir: str, query, text: str) -> tuple[list, list, int]:
    """Rows that only Spark has, rows that only SQL has, and rows in all."""
    df = query(spark, sf_dir)
    out = str(tmp / "got")
    df.write.mode("overwrite").parquet(out)
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    con.execute(f"CREATE TABLE want AS SELECT * FROM ({text})")
    assert sorted(df.columns) == sorted(r[0] for r in con.execute("DESCRIBE want").fetchall())
    con.execute(f"CREATE TABLE have AS SELECT {cols} FROM '{out}/*.parquet'")
    con.execute(f"CREATE TABLE need AS SELECT {cols} FROM want")
    more = con.execute("SELECT * FROM have EXCEPT ALL SELECT * FROM need").fetchall()
    less = con.execute("SELECT * FROM need EXCEPT ALL SELECT * FROM have").fetchall()
    return more, less, con.execute("SELECT count(*) FROM need").fetchall()[0][0]
