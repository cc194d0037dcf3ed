"""What travels, and how often."""

from conftest import DATA
from pyspark.sql import functions as F

from storyweave import fixtures as fx
from storyweave.operators import pairs


def joined(plan):
    """The columns that each join of a plan hands on."""
    own = [[a.name() for a in (plan.output().apply(k) for k in range(plan.output().size()))]] if plan.nodeName() == "Join" else []
    return own + [x for k in range(plan.children().size()) for x in joined(plan.children().apply(k))]


def test_texts_stay_where_their_signals_are_made(spark):
    plan = fx.signalled_items(spark, DATA).select("item_id", "entities", "embedding")._jdf.queryExecution().optimizedPlan()
    columns = joined(plan)
    assert columns and all("entities" in c and "text" not in c for c in columns)


def test_many_groups_need_no_more_tiles(spark):
    rows = spark.range(100_000).select("id", (F.col("id") % 20).alias("slab"), F.array(F.rand(1), F.rand(2)).alias("vec"))
    tiled, _ = pairs.with_pivot_tiles(rows, ["slab"], "id", "vec", None)
    assert tiled.select("tile").distinct().count() == 20


def test_tiles_of_long_vectors_are_small(spark, monkeypatch):
    monkeypatch.setattr(pairs, "MOST_NUMBERS", 6000)
    rows = spark.range(9000).select("id", F.lit(0).alias("slab"), F.array(F.rand(1), F.rand(2), F.rand(3)).alias("vec"))
    tiled, _ = pairs.with_pivot_tiles(rows, ["slab"], "id", "vec", None, least=10)
    sizes = [r["count"] for r in tiled.groupBy("tile").count().collect()]
    assert sum(sizes) == 9000 and max(sizes) < 2400
