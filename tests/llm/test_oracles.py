"""Every query of the training-data operators that has an oracle, against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from quillnet.llm import queries as Q


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, sf, name):
    db = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = Q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    mine = sorted(str([cell(r[c]) for c in cols]) for r in df.collect())
    cur = db.execute(Q.ORACLES[name])
    at = {d[0]: k for k, d in enumerate(cur.description)}
    assert sorted(at) == cols
    assert mine == sorted(str([cell(r[at[c]]) for c in cols]) for r in cur.fetchall())
