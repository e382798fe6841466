import random

from pyspark.sql import functions as F

from eventloom.functions.ordering import numbered, running_total


def test_running_total_of_a_hot_key(spark):
    rng = random.Random(7)
    # One key holds most rows and many rows share a moment.
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", rng.randrange(40), i, rng.randrange(9)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k STRING, at INT, id INT, v BIGINT").repartition(8)
    got = {r.id: r.total for r in running_total(df, ["k"], [F.col("at"), F.col("id")], F.col("v"), "total").collect()}
    sums, want = {}, {}
    for k, at, i, v in sorted(rows):
        sums[k] = sums.get(k, 0) + v
        want[i] = sums[k]
    assert got == want


def test_numbering_without_keys_is_dense(spark):
    df = spark.range(1000).repartition(7)
    got = sorted((r.row_no, r.id) for r in numbered(df, [], [F.desc("id")]).collect())
    assert got == [(i + 1, 999 - i) for i in range(1000)]
