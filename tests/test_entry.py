"""The driver's contract: names, SQL for the same names, and independence of the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "object_metrics" in entry.queries()


def test_flagship(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() == 75


def _without(tmp_path, *absent):
    """A copy of the repository without some of its folders and files."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__", ".pytest_cache") or os.path.relpath(os.path.join(folder, n), ROOT) in absent])
    return copy


def _run(copy, *command):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, *command], cwd=copy, capture_output=True, text=True, env=env, timeout=600)


def test_the_rest_works_without_the_subpackage(tmp_path):
    copy = _without(tmp_path, "trackspark/llm", "tests/llm", "corpus_pipeline.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'object_metrics' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    done = _run(copy, "-c", code)
    assert done.returncode == 0, done.stderr
    done = _run(copy, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_tracks.py", "-k", "gaps or labels or csv")
    assert done.returncode == 0, done.stdout + done.stderr


def test_a_missing_need_of_the_subpackage_is_an_error(tmp_path):
    copy = _without(tmp_path, "trackspark/llm/secrets.py")
    done = _run(copy, "-c", "import __spark_entry__")
    assert done.returncode != 0 and "secrets" in done.stderr


def test_code_reaches_workers_that_have_no_copy_of_it(tmp_path):
    if not os.path.isdir("/root/testdata/sf0.001"):
        return
    code = (
        "import sys, os; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "assert 'PYTHONPATH' not in os.environ or sys.argv[1] not in os.environ['PYTHONPATH']\n"
        "for n in sys.argv[2:]:\n    print(n, e.queries()[n](s, '/root/testdata/sf0.001').count())\n"
    )
    names = [n for n in ("object_metrics", "op7_packing") if n in entry.queries()]
    done = _run(tmp_path, "-c", code, ROOT, *names)
    assert done.returncode == 0 and len(done.stdout.split("\n")) > len(names), done.stderr[-2000:]
