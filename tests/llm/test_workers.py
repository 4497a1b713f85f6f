"""Executors have no copy of the package: functions travel by value."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
NAMES = ["op2_language", "op4_scoring", "op6_simhash", "op11_alignment", "op12_lexical", "op13_suffixes"]


def test_queries_run_where_workers_cannot_import_the_package(tmp_path, sf):
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {str(REPO)!r})
        from workload.check import session
        from scorewright.llm.queries import QUERIES
        spark = session("4")

        def alone(batches):
            try:
                import scorewright
            except ModuleNotFoundError:
                yield from batches

        assert spark.range(3).mapInArrow(alone, "id long").count() == 3
        for name in {NAMES!r}:
            QUERIES[name](spark, {sf!r}).write.format("noop").mode("overwrite").save()
            print("ran", name, flush=True)
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, script], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert [line for line in run.stdout.splitlines() if line.startswith("ran")] == [f"ran {n}" for n in NAMES], run.stderr[-2000:]
