from strandline.plans import sizes


def test_a_broadcast_needs_a_small_table(spark):
    left, right = spark.range(1000).toDF("k"), spark.range(50).toDF("k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = lambda most: left.join(sizes.sent_if_small(right, most), "k", "left_semi")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan(50) and "Broadcast" not in plan(49)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sizes.small(right, 50) and not sizes.small(right, 49)
