"""Files mapped to every active workspace, however many there are."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import workspace
from graphloom.plans.graph import Graph


@pytest.mark.parametrize("most", [100_000, -1])
def test_mapped_to_all(spark, monkeypatch, most):
    monkeypatch.setattr("graphloom.operators.workspace.BROADCAST_SPACES", most, raising=False)
    nodes = spark.range(1203).select(F.concat(F.lit("w"), "id").alias("id"), F.lit("Workspace").alias("label"), F.when(F.col("id") < 1200, "active").otherwise("inactive").alias("status"))
    edges = spark.createDataFrame([(i, p, "DECLARED_IN") for i in ("f", "g", "h") for p in ("a.py", "b.py")] + [("f", "a.py", "DECLARED_IN"), ("k", "a.py", "CALLS")], "from_id string, to_id string, relationship string")
    got = [(r.from_id, r.to_id) for r in workspace.mapped(Graph(nodes, edges), "a.py").collect()]
    assert sorted(got) == sorted((f"w{k}", i) for k in range(1200) for i in ("f", "g", "h"))
