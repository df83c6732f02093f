"""Tables that grow with the input are not sent to the driver and from there to all executors."""

from quotewright.llm import topk
from quotewright.llm.common import Scratch
from quotewright.plans import source_queries


def broadcasts(spark, run) -> list[int]:
    """Rows of the broadcasts in all jobs that run() starts, where files and joins look small enough for them."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        run().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found, rows = store.executionsList(before, 1_000), []
    assert found.size()
    for i in range(found.size()):
        at = found.apply(i).executionId()
        nodes, values = store.planGraph(at).allNodes(), store.executionMetrics(at)
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if node.name() == "BroadcastExchange":
                for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        rows.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return rows


def test_top_k_broadcasts_no_vectors(spark):
    v = spark.createDataFrame([(i, [i % 7, i % 5]) for i in range(300)], "vec_id bigint, v array<bigint>")
    assert broadcasts(spark, lambda: topk.search(v, Scratch(spark), every=10, block=64, query_block=8, bins=8)) == []


def test_paired_files_broadcast_no_rows(spark):
    got = broadcasts(spark, lambda: source_queries.paired_adapter(spark, "/root/testdata/sf0.01").groupBy().count())
    assert max(got, default=0) < 100
