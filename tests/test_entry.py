import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("hidden", ["docweave.llm", "public_tokenizers", "corpus_pipeline"])
def test_the_other_queries_stay_where_something_is_not_installed(hidden):
    code = f"""
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == {hidden!r} or name.startswith({hidden + "."!r}):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as E
from docweave.plans import catalog
names = set(E.queries())
assert set(catalog.QUERIES) <= names and set(E.oracle_sql()) <= names
assert "pipeline" not in names
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120, env={**os.environ, "PYTHONPATH": ROOT})
