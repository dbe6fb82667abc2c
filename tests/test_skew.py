"""A customer holding a third of all orders: the cleaning job's customer
join is split by AQE instead of landing in one task, and the result is
the same as without the split."""

import tempfile

from pyspark.sql import functions as F

from conftest import TESTDATA

from loanscope.sources.store import build_loans


def test_hot_customer_join_is_split(spark):
    src = str(TESTDATA / "sf0.01")
    d = tempfile.mkdtemp(prefix="loanscope-skew-")
    orders = spark.read.parquet(f"{src}/orders.parquet")
    hot = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1).cast("bigint"))
                            .otherwise(F.col("o_custkey")))
    hot.write.parquet(f"{d}/orders.parquet")
    for t in ("lineitem", "customer", "nation"):
        spark.read.parquet(f"{src}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")

    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        # keep several map tasks upstream: a skewed partition is split
        # along map-output boundaries, as it would be on a large input
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = build_loans(spark, d).select("loan_id", "total_pymnt", "annual_inc")
        split = df.collect()
        final_plan = df._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
        whole = build_loans(spark, d).select("loan_id", "total_pymnt", "annual_inc").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert sorted(map(tuple, split)) == sorted(map(tuple, whole))
    assert len(split) == orders.count()
    assert "skew=true" in final_plan
