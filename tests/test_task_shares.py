"""What one task holds does not grow with the store."""

from quadlake.operators import scan
from quadlake.quads import as_set
from quadlake.session import tune_quads


def test_rows_are_dealt_out_before_they_are_held(make):
    q = make(("g", "a", "p", "b"), ("g", "a", "p", "b"), ("h", "a", "p", "b"))
    for found, n in ((as_set(q), 2), (scan.default_graph(q), 1)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        assert plan.rindex("HashAggregate") < plan.index("Exchange")
        assert found.count() == n


def test_settings_of_a_caller_stay(spark):
    key, other = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    session = spark.newSession()
    session.conf.set(key, "1m")
    tune_quads(session)
    assert session.conf.get(key) == "1m" and session.conf.get(other) == "16m"
