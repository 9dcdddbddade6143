"""Every core query runs on the smallest tables and equals its SQL where it has one."""

import pytest
import verify
from orebody.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return verify.connect(FOLDER)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    ok, said = verify.compare(spark, con, name, catalogue.QUERIES[name], catalogue.SQL.get(name), FOLDER)
    assert ok, said


def test_catalogue_stands_alone():
    import ast
    from pathlib import Path

    root = Path(catalogue.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(".llm" in n for n in names), path
