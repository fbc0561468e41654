from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_nothing_outside_llm_imports_it():
    for path in (ROOT / "tracelark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "tracelark").parts:
            assert "tracelark.llm" not in path.read_text()


def test_entry_imports_without_llm():
    hide = "import sys; sys.modules['tracelark.llm'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", hide], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 60


def test_workers_find_the_package_from_any_folder(tmp_path):
    """The session comes first, then the entry module, from a folder that the workers don't look into."""
    run = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print(spark.range(4).mapInArrow(lambda batches: batches, "id long").count())
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
print(e.queries()["w2_call_depth"](spark, e.SMOKE_DIR).count())
"""
    done = subprocess.run([sys.executable, "-c", run], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.split()[0] == "4" and int(done.stdout.split()[1]) > 100
