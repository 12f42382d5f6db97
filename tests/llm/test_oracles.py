import sys
from pathlib import Path

import duckdb
import pytest
from loamgraph.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names) and len(rows) > 20
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, rows))


def test_nothing_else_imports_this_subpackage():
    root = Path(__file__).parents[2]
    others = [p for p in [*(root / "loamgraph").rglob("*.py"), *(root / "tests").glob("*.py"), root / "bench.py"] if "llm" not in p.parts]
    assert not [p for p in others if "loamgraph.llm" in p.read_text() or "from loamgraph import llm" in p.read_text()]
    assert "loamgraph.llm" in sys.modules
