import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_names_and_sql_belong_together():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    assert all(callable(q) for q in queries.values())


def test_core_does_not_import_llm():
    for path in (ROOT / "searchlake").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(?:from|import)\s+searchlake\.llm", path.read_text()), path
