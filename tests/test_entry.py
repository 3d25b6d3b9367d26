import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_sql():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "word_count" in o and all(callable(f) for f in q.values())


def test_imports_without_training_operators(tmp_path):
    shutil.copytree(ROOT / "weftarc", tmp_path / "weftarc", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'word_count' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_training_operators():
    for p in (ROOT / "weftarc").rglob("*.py"):
        if "llm" not in p.parts:
            assert "weftarc.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p
