"""The entry module with and without the optional parts."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
HIDE = """
import sys, warnings
sys.path.insert(0, {root!r})
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    import __spark_entry__ as E
names = set(E.queries())
assert "span_candidates" in names and len(names) > 180, len(names)
assert not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
assert set(E.oracle_sql()) <= names
assert any({said!r} in str(w.message) for w in said), [str(w.message) for w in said]
"""


@pytest.mark.parametrize("name", ["public_tokenizers", "regex", "trailworks.llm", "corpus_pipeline"])
def test_core_queries_do_not_need_optional_modules(name):
    # where the package itself is left out, that is what the warning names
    said = name if (ROOT / "corpus_pipeline.py").exists() and (ROOT / "trailworks" / "llm").exists() else ""
    done = subprocess.run([sys.executable, "-c", HIDE.format(root=str(ROOT), name=name, said=said)], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
