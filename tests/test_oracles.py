"""Every core query with SQL agrees with it; every other one has a brute-force version."""

import pytest

from murmurlake.plans import registry

from .conftest import DATA
from .helpers import spark_rows, sql_rows

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, DATA)) == sql_rows(duck, ORACLES[name])


def test_what_has_no_sql_has_a_brute_force():
    """Sound codes and alignments are beyond SQL; tests/test_brute.py compares these on the data."""
    from .test_brute import BRUTE

    assert set(QUERIES) - set(ORACLES) == set(BRUTE)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_the_optional_package():
    import ast
    import pathlib

    root = pathlib.Path(__file__).parents[1] / "murmurlake"
    for f in root.rglob("*.py"):
        if "llm" in f.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("murmurlake.llm") for n in names), f
