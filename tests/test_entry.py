"""The registered queries without the folder of text operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)], ids=["neither", "pipeline_left"])
def test_imports_without_text_operators(tmp_path, left):
    shutil.copytree(REPO / "footfall", tmp_path / "footfall", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *left):
        if (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path / name)
    said = "import __spark_entry__ as e; print(len(e.queries()), sorted(k for k in e.queries() if k.startswith('op') or k == 'pipeline'))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    count, names = done.stdout.split(" ", 1)
    assert int(count) > 60 and names.strip() == "[]"
