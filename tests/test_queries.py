"""Every query with an oracle against DuckDB; the entry without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quillnet.plans import queries as Q

ROOT = Path(__file__).parent.parent


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) else [cell(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


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


def test_stands_alone(tmp_path):
    code = "import sys; sys.modules['quillnet.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'search_documents' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
