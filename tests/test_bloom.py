from pyspark.sql import functions as F

from tussis.operators.bloom import might_be_in


def test_members_stay_and_nearly_all_others_go(spark):
    rows = spark.range(0, 20_000).select(F.concat(F.lit("r"), "id").alias("k"), F.col("id").alias("n"))
    ids = rows.where("n % 10 = 3").select("k")
    got = {r.n for r in might_be_in(rows.unionByName(spark.createDataFrame([(None, -1)], "k string, n long")), ids, "k").collect()}
    members = {n for n in range(20_000) if n % 10 == 3}
    assert members <= got and len(got - members) < 20 and -1 not in got
    assert might_be_in(rows, ids.limit(0), "k").count() == 0
