"""The entry points with and without the training-data operators."""
import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(where: str) -> list[str]:
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=where, env={**os.environ, "PYTHONPATH": where}, capture_output=True, text=True, check=True).stdout.split()


def copied(where) -> str:
    shutil.copytree(os.path.join(ROOT, "braid"), where / "braid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), where)
    return str(where)


def test_import_without_operators(tmp_path):
    found = names(copied(tmp_path))
    assert "fused_profile" in found and "pipeline" not in found and not [n for n in found if n.startswith("op")]


def test_other_errors_are_raised(tmp_path):
    where = copied(tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there")
    code = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=where, env={**os.environ, "PYTHONPATH": where}, capture_output=True, text=True)
    assert code.returncode and "a_module_that_is_not_there" in code.stderr


def test_engine_imports_no_operators():
    for folder, dirs, files in os.walk(os.path.join(ROOT, "braid")):
        dirs[:] = [d for d in dirs if d != "llm"]
        for name in files:
            if name.endswith(".py"):
                assert "braid.llm" not in open(os.path.join(folder, name), encoding="utf-8").read(), name
