"""Sides of joins that grow with the input are not broadcast, however small Spark takes them for."""

from matchloom.operators import graph, mining


def plans(spark, run):
    """Physical plans of all executions of run, as text."""
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda: [e for e in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executionsList())]
    before = {e.executionId() for e in listed()}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return "\n".join(e.physicalPlanDescription() for e in listed() if e.executionId() not in before)


def test_short_forms_broadcast_nothing(spark):
    rows = spark.createDataFrame([(p, [f"w{p % 3}", f"w{p % 4}", f"v{p}"]) for p in range(12)], "id int, w array<string>")
    text = plans(spark, lambda: mining.short_forms(rows, "id", "w").collect())
    assert "SortMergeJoin" in text and "BroadcastExchange" not in text


def test_long_sides_are_shuffled(spark):
    side, other = spark.range(5), spark.range(9)
    assert "BroadcastExchange" not in plans(spark, lambda: other.join(graph.sided(side, 4), "id").collect())
    assert "BroadcastExchange" in plans(spark, lambda: other.join(graph.sided(side, 5), "id").collect())
