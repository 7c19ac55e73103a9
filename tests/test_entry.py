import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "bm25_any_topk" in entry.queries()


def test_core_does_not_need_the_subpackage():
    code = "import sys; sys.modules['parchmint.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(q[0] == 'p' and q[1].isdigit() for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)
    core = [p for p in (REPO / "parchmint").rglob("*.py") if "llm" not in p.parts]
    assert not any("parchmint.llm" in p.read_text() for p in core)
