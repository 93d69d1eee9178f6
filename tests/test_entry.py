"""What the driver imports: also without the training-data subpackage."""

import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__
import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["page", "link"] and got.count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [("weftline.llm", "corpus_pipeline"), ("corpus_pipeline",)])
def test_imports_without_training_data_modules(gone):
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in {gone!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "canonical_links" in e.queries() and "pipeline" not in e.queries()
assert ("op1_token_ids" in e.queries()) == {"weftline.llm" not in gone and (ROOT / "weftline" / "llm").exists()}
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "weftline").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b|corpus_pipeline", path.read_text()), path
