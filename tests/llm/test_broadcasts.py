"""What is copied for many tasks does not pass the driver."""

from pyspark.sql import functions as F

from storyweave.llm import mtree


def test_query_blocks_are_not_broadcast(spark):
    x = F.col("id").cast("double")
    rows = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(F.sin(x), F.cos(x * 3), F.sin(x * x)).alias("embedding"))
    found = mtree.top_k(rows, F.col("vec_id") % 10 == 0)
    assert found.count() == 200 * 10
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    joins = [line for line in plan.splitlines() if "Join" in line and "lane" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
