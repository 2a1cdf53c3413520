"""The registry from another folder and without the optional operators."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {folder!r}).config("spark.sql.shuffle.partitions", "4").getOrCreate()
from __spark_entry__ import queries
for name in {names!r}:
    print("ROWS", name, queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
spark.stop()
"""


def run(script: str, folder: Path) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=folder, env=env, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


def test_kernels_reach_workers_that_do_not_have_the_package(tmp_path):
    names = ["cluster_matching", "batch_search", "trend_distribution"]
    (tmp_path / "away").mkdir()
    out = run(SCRIPT.format(repo=str(REPO), folder=f"file://{tmp_path}/shared", names=names), tmp_path / "away")
    assert all(f"ROWS {name} " in out for name in names)


def test_registry_without_the_optional_folder(tmp_path):
    (tmp_path / "cairnflow").mkdir()
    for part in (REPO / "cairnflow").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "cairnflow" / part.name).symlink_to(part)
    (tmp_path / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    check = "import __spark_entry__ as e; names = set(e.queries()); assert 'opportunity_ranking' in names and not any(n.startswith('op') and n[2].isdigit() for n in names); assert set(e.oracle_sql()) <= names; print('fine')"
    assert "fine" in run(check, tmp_path)
