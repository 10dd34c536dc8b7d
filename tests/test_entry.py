"""The entry module without the corpus subpackage, and results that would prove nothing if they were empty."""

import os
import shutil
import subprocess
import sys

import pytest
from oracle import differences

from strandline.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.01"


def test_entry_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/strandline", tmp_path / "strandline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


@pytest.mark.parametrize("name", ["agg03_jamming_grid", "idr03_pair_review", "set06_watchlist_missing", "str12_rate_limit"])
def test_results_are_not_empty(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
    assert differences(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) == ""
