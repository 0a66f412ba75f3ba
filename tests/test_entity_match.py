"""Best matches over tokens that very many names share."""

from pyspark.sql import functions as F

from labelloom.operators import reconcile


def test_common_tokens_still_match(spark):
    rows = [(i, f"Tata Foods{'' if i % 2 else ' Agro'} x{i}") for i in range(250)] + [(900, "Tata Foods Zeta"), (901, "Tata Tata Agro")]
    names = [(1, "Tata Foods"), (2, "Nobody Else"), (3, "Foods Tata Agro"), (4, "Tata Foods x7"), (5, None)]
    right, left = (spark.createDataFrame(x, "id long, name string") for x in (rows, names))
    got = {r.id: (r.match_id, r.score) for r in reconcile.best_match(left, right).collect()}
    l, r = left.toDF("l_id", "l_name"), right.toDF("r_id", "r_name")
    every = l.crossJoin(r).withColumn("score", reconcile.similarity(F.col("l_name"), F.col("r_name"))).collect()
    best = {i: max((x.score, -x.r_id) for x in every if x.l_id == i) for i in (1, 3, 4)}
    assert got == {i: (-k, s) for i, (s, k) in best.items()} | {2: (None, None), 5: (None, None)}
