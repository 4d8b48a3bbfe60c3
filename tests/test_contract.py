"""The driver contract and the plan properties the design relies on."""

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"page_id", "title", "n_chars", "status"} <= set(df.columns)


def test_every_oracle_names_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 50


def test_scan_prunes_columns(spark):
    plan = E.queries()["dup_urls"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    # documents are read without the columns the query does not need
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan


def test_language_probe_is_broadcast(spark):
    plan = E.queries()["doc_language"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
