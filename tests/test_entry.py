"""The driver entry without the training-data subpackage, in a copy of the repository."""

import os
import shutil
import subprocess
import sys

import pytest

from mnemolake.plans import registry
from tests.conftest import ROOT

registry.load()


@pytest.mark.parametrize("gone", [["mnemolake/llm", "tests/llm"], ["mnemolake/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_parts(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *[g.rsplit("/")[-1] for g in gone]))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), sum(k.startswith('op') or k == 'pipeline' for k in q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"}, timeout=120)
    assert said.returncode == 0, said.stderr
    n, o, llm = map(int, said.stdout.split())
    there = os.path.isdir(f"{ROOT}/mnemolake/llm") and "mnemolake/llm" not in gone
    assert (n - llm, o >= len(registry.ORACLES)) == (len(registry.QUERIES), True) and (llm > 0) == there
    tests = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert tests.returncode == 0 or "corpus_pipeline" in tests.stdout, tests.stdout[-500:]


def test_a_cluster_must_name_the_shared_folder():
    from types import SimpleNamespace

    from mnemolake.plans.storage import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
