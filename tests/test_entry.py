"""Driver contract: entry() runs on sf0.001; every query key is registered consistently."""

import __spark_entry__ as E
from vigil.plans.catalog import REGISTRY


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "comment_id" in df.columns


def test_oracle_keys_are_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    # Only models and the report of a model's training go without an oracle (the optional
    # queries have tests of their own).
    rows_only = set(REGISTRY) - set(o)
    assert rows_only <= {"train_score", "fit_epochs", "embedding_head", "stream_report", "train_report", "train_epochs", "model_saved", "scan_pages_model", "queue_model"}


def test_every_query_runs_at_sf0001(spark):
    for name, fn in REGISTRY.items():
        df = fn(spark, "/root/testdata/sf0.001")
        df.write.format("noop").mode("overwrite").save()
        assert df.columns, name


def test_python_worker_queries_run_outside_the_repo():
    """Pandas-UDF and keyed-state queries ship the package: they run from any working directory."""
    import os
    import subprocess
    import sys
    import tempfile

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "import __spark_entry__ as E\n"
        "from vigil.session import local_session\n"
        "s = local_session(2, 2)\n"
        "print('ROWS', E.queries()['page_elements_dom'](s, '/root/testdata/sf0.001').count())\n" % repo
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tempfile.gettempdir(), capture_output=True, text=True,
                         timeout=600)
    assert "ROWS " in out.stdout, out.stderr[-2000:]
