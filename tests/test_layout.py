import ast
from pathlib import Path

import corpusloom

HOME = Path(corpusloom.__file__).parent


def test_nothing_outside_llm_imports_it():
    for path in HOME.rglob("*.py"):
        if "llm" in path.relative_to(HOME).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else []
            if isinstance(node, ast.ImportFrom):
                names = [f"{node.module}.{a.name}" for a in node.names]
            assert not any(n.startswith("corpusloom.llm") for n in names), path


def test_workers_have_the_package(spark):
    from corpusloom.runtime import map_batches

    def run(batches):
        import corpusloom.functions.urls  # noqa: F401

        yield from batches

    assert map_batches(spark.range(3), run, "id bigint").count() == 3


def test_kept_frames_survive(spark):
    from corpusloom.runtime import cut, shared_folder

    assert shared_folder(spark)
    assert sorted(r[0] for r in cut(spark.range(4)).collect()) == [0, 1, 2, 3]
