"""The entry module with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = (
    "import __spark_entry__ as e; q = e.queries(); assert 'sediment_volumes_manual' in q; "
    "assert not [k for k in q if k.startswith('op') and k[2].isdigit() or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
)


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "sediment_volumes_manual" in e.queries()


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_llm(tmp_path, pipeline):
    """The rest works with the subpackage deleted, be the pipeline's file there or not."""
    shutil.copytree(f"{REPO}/shoalgrid", tmp_path / "shoalgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{REPO}/{name}") and (pipeline or name != "corpus_pipeline.py"):
            shutil.copy(f"{REPO}/{name}", tmp_path)
    path = os.pathsep.join([str(tmp_path), *(x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and os.path.realpath(x) != os.path.realpath(REPO))])
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": path})
