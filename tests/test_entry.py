"""The driver's contract holds with and without the subpackage that may be taken away."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_match():
    import __spark_entry__ as e

    assert "size_profile" in e.queries() and e.oracle_sql().keys() <= e.queries().keys()


def test_without_the_subpackage():
    code = "import sys; sys.modules['quarry.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'size_profile' in e.queries() and e.oracle_sql(); assert not [n for n in e.queries() if n.startswith('op') and n[2].isdigit()]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "quarry").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "quarry").parts:
            assert "quarry.llm" not in f.read_text(), f
