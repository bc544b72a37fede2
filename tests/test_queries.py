from __future__ import annotations

import pytest

from cuelight import plans
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, data, name):
    same(spark, data, plans.QUERIES[name], plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_runs(spark, data, name):
    df = plans.QUERIES[name](spark, data)
    assert df.columns and df.count() > (-1 if name == "stock_phrases" else 0)  # the tables hold no stock phrase


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_survey_agrees_with_the_delivered_survey(spark, data):
    """The table of surveys counts over distinct cues, as the operator does."""
    given = {(r.stem, r.reel): r for r in spark.read.parquet(f"{data}/cue_stats.parquet").collect()}
    got = plans.QUERIES["survey_counts"](spark, data).collect()
    assert got
    for r in got:
        g = given[r.stem, r.reel]
        assert (r.cues, r.text_cues, r.empty_cues, r.ruby_runs, r.drcs) == (g.cues, g.text_cues, g.empty_cues, g.ruby_runs, g.drcs)
