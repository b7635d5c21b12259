"""The driver contract holds with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(n == 'pipeline' or n.startswith('op') for n in q))"


def run(at):
    env = {**os.environ, "PYTHONPATH": str(at), "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", CODE], cwd=at, env=env, capture_output=True, text=True, timeout=120)


def copy(to):
    shutil.copytree(os.path.join(ROOT, "waypoint"), to / "waypoint", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), to)


def test_entry_without_the_subpackage(tmp_path):
    copy(tmp_path)
    done = run(tmp_path)
    assert done.returncode == 0 and int(done.stdout.split()[0]) > 200 and done.stdout.split()[1] == "0", done.stderr


def test_an_empty_folder_counts_as_absent(tmp_path):
    copy(tmp_path)
    (tmp_path / "waypoint" / "llm" / "__pycache__").mkdir(parents=True)
    done = run(tmp_path)
    assert done.returncode == 0 and done.stdout.split()[1] == "0", done.stderr


def test_a_broken_subpackage_is_not_hidden(tmp_path):
    copy(tmp_path)
    (tmp_path / "waypoint" / "llm").mkdir()
    (tmp_path / "waypoint" / "llm" / "__init__.py").write_text("")
    (tmp_path / "waypoint" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    done = run(tmp_path)
    assert done.returncode != 0 and "a_module_that_is_not_there" in done.stderr
