import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_core_stands_alone():
    """Nothing outside the corpus subpackage names it."""
    code = "import sys; sys.modules['weftline.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op') and q[2].isdigit()]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
