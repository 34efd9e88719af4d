import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings voice_blocks works_manifest control_corpora block_scores raw_lines preprocessing_log eval_items".split()


@pytest.fixture(scope="session")
def spark():
    from versloom.session import build_session

    s = build_session("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = Path(DATA, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(value):
    """A value as text that doesn't depend on the engine's number type."""
    if value is None:
        return "-"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        return f"{float(value):.7g}"
    return str(value)


@pytest.fixture(scope="session")
def same_rows():
    def check(df, relation):
        cols = sorted(df.columns)
        assert cols == sorted(relation.columns)
        ours = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
        theirs = sorted(tuple(map(plain, r)) for r in relation.select(*[f'"{c}"' for c in cols]).fetchall())
        assert ours == theirs

    return check
