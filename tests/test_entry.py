"""The driver's entry file, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q)
print(len(q), any(n.startswith("op") for n in q), "pipeline" in q)
"""


def run_copy(folder):
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_without_the_optional_subpackage(tmp_path):
    shutil.copytree(HERE, tmp_path / "whole", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    from sufloom.plans import catalog

    assert run_copy(tmp_path / "whole") == [str(len(catalog.QUERIES)), "False", "False"]
    os.remove(tmp_path / "whole" / "corpus_pipeline.py") if (tmp_path / "whole" / "corpus_pipeline.py").exists() else None
    assert run_copy(tmp_path / "whole") == [str(len(catalog.QUERIES)), "False", "False"]


def test_other_import_errors_are_raised(tmp_path):
    shutil.copytree(HERE, tmp_path / "whole", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    (tmp_path / "whole" / "corpus_pipeline.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path / "whole", env={**os.environ, "PYTHONPATH": str(tmp_path / "whole")}, capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module" in done.stderr
