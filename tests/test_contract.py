"""The driver's three functions, and independence from the training-data subpackage."""

from __future__ import annotations

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "hybrid_score" in df.columns


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90


def test_imports_without_the_subpackage(tmp_path):
    code = ("import sys\nsys.modules['tidewell.llm'] = None\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\n"
            "assert len(e.queries()) > 80 and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())")
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(REPO, "tidewell")):
        if "llm" not in folder:
            assert not any("tidewell.llm" in open(os.path.join(folder, n)).read() for n in names if n.endswith(".py"))
