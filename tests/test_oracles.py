from pathlib import Path

import pytest

from oracle import compare
from triagewright import registry

ROOT = Path(registry.__file__).parent


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_nothing_imports_the_corpus_operators():
    files = [p for p in ROOT.rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert files and not [p for p in files if "triagewright.llm" in p.read_text()]


@pytest.mark.parametrize("name, made_of", [("corrections", "1750000000"), ("match_history", "1700000000")])
def test_rows_that_a_query_needs_several_times_are_worked_out_once(spark, name, made_of):
    """Corrections are needed as events and as rejects, the state by either id: the plan reads them, it doesn't make them again."""
    assert made_of not in registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
