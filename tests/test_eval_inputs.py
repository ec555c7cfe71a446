"""The evaluation makes its queries once and holds nothing in memory."""

import __spark_entry__
from mentionforge.plans import table_queries
from mentionforge.sources import views


def test_evaluation_makes_its_queries_once(spark, monkeypatch):
    made, view = [], views.view

    def counted(spark, sf_dir, name, given=None):
        made.extend([name] * (name == "fx_queries" and not (given and name in given)))
        return view(spark, sf_dir, name, given)

    monkeypatch.setattr(views, "view", counted)
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = held()
    cases = table_queries.eval_cases(spark, "/root/testdata/sf0.001")
    assert made == ["fx_queries"] and cases.count() == __spark_entry__.queries()["gold_scan"](spark, "/root/testdata/sf0.001").select("query_id").distinct().count() + cases.where("expected_status = 'no_match'").count()
    assert held() == before
