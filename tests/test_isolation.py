"""Without the training-data folders the rest still imports and keeps its queries."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"


def test_entry_without_the_training_data_folders(tmp_path):
    gone = ("quarrystone/llm", "tests/llm")
    shutil.copytree(REPO, tmp_path / "r", ignore=lambda d, names: [n for n in names if n in (".git", "corpus_pipeline.py", "__pycache__") or os.path.relpath(os.path.join(d, n), REPO) in gone])
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "r", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert run.returncode == 0, run.stderr


def test_a_broken_training_data_module_is_not_swallowed(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    target = tmp_path / "r/quarrystone/llm/queries.py"
    if not target.exists():
        return
    target.write_text("import a_module_that_is_not_there\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "r", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert run.returncode != 0 and "a_module_that_is_not_there" in run.stderr
