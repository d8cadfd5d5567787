"""The entry module without the training-data subpackage, or without a library that only it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", ["loomwork.llm", "corpus_pipeline", "ahocorasick"])
def test_other_queries_stay(gone):
    code = f"import sys; sys.modules[{gone!r}] = None; import __spark_entry__ as e; n = e.queries(); assert len(n) > 70 and 'pipeline' not in n and not any(x.startswith('op') for x in n); assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=300)
