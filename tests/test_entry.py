import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_works_without_the_optional_parts(tmp_path):
    for x in ("graphloom", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / x).is_dir() else shutil.copy)(ROOT / x, tmp_path / x)
    shutil.rmtree(tmp_path / "graphloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bfs_levels' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_a_subpackage_that_cannot_be_imported_is_left_out(tmp_path):
    for x in ("graphloom", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if (ROOT / x).is_dir() else shutil.copy)(ROOT / x, tmp_path / x)
    (tmp_path / "graphloom/llm/words.py").write_text("import a_module_that_is_not_there\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bfs_levels' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, capture_output=True, text=True)
    assert "a_module_that_is_not_there" in done.stderr


def test_the_other_tests_pass_without_the_optional_parts(tmp_path):
    """The tests that don't need long, with the subpackage, its tests and the pipeline deleted."""
    for x in ("graphloom", "tests", "__spark_entry__.py", "bench.py"):
        (shutil.copytree if (ROOT / x).is_dir() else shutil.copy)(ROOT / x, tmp_path / x)
    for x in ("graphloom/llm", "tests/llm"):
        shutil.rmtree(tmp_path / x, ignore_errors=True)
    chosen = ["tests/test_graph.py", "tests/test_sources.py", "tests/test_entry.py::test_nothing_else_imports_the_subpackage", "tests/test_entry.py::test_entry"]
    subprocess.run([sys.executable, "-m", "pytest", "-x", "-q", "-p", "no:cacheprovider", "--deselect", "tests/test_graph.py::test_a_deep_search_ends", *chosen], cwd=tmp_path, check=True, timeout=600)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "graphloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "graphloom.llm" not in p.read_text()


def test_entry(spark):
    import __spark_entry__

    levels = {r.level: r.vertices for r in __spark_entry__.entry(spark).collect()}
    assert levels[0] == 1 and sum(levels.values()) == 200
