"""The entry module with and without the folder of training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

from suite.queries import REGISTRY

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_the_rest_imports_without_the_training_data_folder(tmp_path, pipeline_too):
    tree = tmp_path / "tree"
    skipped = {os.path.join(ROOT, "tidemark", "llm"), os.path.join(ROOT, "tests", "llm")}

    def without(folder, names):
        gone = {n for n in names if os.path.join(folder, n) in skipped or n in (".git", "__pycache__")}
        return gone | ({"corpus_pipeline.py"} if pipeline_too else set())

    shutil.copytree(ROOT, tree, ignore=without)
    shown = subprocess.run(
        [sys.executable, "-c", SHOW], cwd=tree, env=os.environ | {"PYTHONPATH": str(tree)}, capture_output=True, text=True, check=True
    )
    queries, sql = (set(line.split()) for line in shown.stdout.splitlines())
    assert queries == sql == set(REGISTRY)
