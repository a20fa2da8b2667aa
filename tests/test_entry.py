import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_queries_and_sql_go_together():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) > 25


def test_it_works_without_the_training_data_operators():
    code = "import sys; sys.modules['groundwork.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; n = set(e.queries()); assert 'bm25_topk' in n and 'pipeline' not in n and not any(x.startswith('op') for x in n)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 40 and any(not r["abstained"] for r in rows)
    assert all(r["citations"] for r in rows if not r["abstained"])
