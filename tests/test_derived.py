"""Derived tables read their lines once."""

from pyspark.sql import functions as F

from spanwright.plans import derived as dv

SF = "/root/testdata/sf0.001"


def test_probabilities_come_from_one_reading_of_the_lines(spark):
    made = dv.order_probabilities(spark, SF)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Window [row_number") == 1
    lines = dv.numbered_lines(spark, SF).select(F.col("l_orderkey").alias("doc_id"), "cid", F.array(
        (F.col("l_quantity") % 11) / 10, (F.col("l_suppkey") % 9) / 8, (F.col("l_partkey") % 13) / 12).alias("q"),
        ((F.col("l_quantity") % 20) / 20).alias("h"))
    gold = dv.order_gold(spark, SF)
    same = made.join(lines, ["doc_id", "cid"]).filter("p = q AND gate = h AND size(picked) = 1")
    n = gold.count()
    assert n > 0 and made.count() == n and same.count() == n
    assert made.select(gold.columns).exceptAll(gold).isEmpty()
