from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from orrery import catalogue
from tests import oracle

ROOT = Path(__file__).resolve().parent.parent
needs_data = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.database(oracle.DATA)


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    oracle.agree(catalogue.queries()[name](spark, oracle.DATA), con, catalogue.oracle_sql()[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_gives_the_same_rows_twice(spark, name):
    run = lambda: sorted(map(repr, catalogue.queries()[name](spark, oracle.DATA).collect()))
    first = run()
    assert first and first == run()


@needs_data
def test_greedy_pairs_keep_their_rules(spark):
    rows = catalogue.queries()["greedy_unique_pairs"](spark, oracle.DATA).collect()
    pairs = [(r["region"], frozenset((r["subject"], r["reference"]))) for r in rows]
    assert len(pairs) == len(set(pairs))
    relations = [(r["region"], r["relation"]) for r in rows]
    assert all(relations.count(x) <= 2 for x in set(relations))


def test_the_entry_works_without_the_text_operators(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "orrery", tmp_path / "orrery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'relation_candidates' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_text_operators():
    for path in (ROOT / "orrery").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "orrery").parts:
            assert "orrery.llm" not in path.read_text().replace("queries of the library outside orrery.llm", "")
