import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_catalogue_is_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


def test_entry(spark):
    import __spark_entry__ as entry

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the synthetic tables are not here")
    assert entry.entry(spark).count() > 0


def test_the_rest_stands_without_the_training_data_part(tmp_path):
    """In a copy without those folders the entry lists the other queries, one of them runs, and other tests pass."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n in {"llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache", "spark-warehouse"} or n.endswith(".json")])
    assert not (copy / "colloquy" / "llm").exists() and not (copy / "tests" / "llm").exists()
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=copy, env=env)
    some = ["tests/test_steps.py", "tests/test_sources.py", "tests/test_operators.py"]
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *some], check=True, cwd=copy, env=env)


def test_a_missing_library_is_told(tmp_path):
    """Without a library that only the training-data part needs, that part is left out with a warning."""
    code = f"import sys; sys.path.insert(0, {ROOT!r}); sys.modules['regex'] = None; import __spark_entry__ as e; assert len(e.queries()) > 50 and 'pipeline' not in e.queries()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0 and "regex" in done.stderr
