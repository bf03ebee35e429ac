import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from wordloom.session import spark_session
spark = spark_session("elsewhere", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
from __spark_entry__ import queries
for name in ("encode_documents", "subsample_words", "gelu_activation", "split_sentences_model"):
    assert queries()[name](spark, {sf!r}).count() > 0, name
print("all ran")
"""


def test_workers_need_no_package(tmp_path, sf):
    """The driver may run anywhere, with the package on its own path only."""
    root = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root, sf=sf)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600,
    )
    assert "all ran" in done.stdout, done.stderr[-3000:]
