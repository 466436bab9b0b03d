import random

from pyspark.sql import functions as F

from gaugeworks.llm.topn import top_n


def brute(rows, n):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return sorted((r[2], k) for g in groups.values() for k, r in enumerate(sorted(g, key=lambda r: (-r[1], r[2]))[:n], 1))


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else rng.choice([None, "", *"abcdefgh"]), rng.randint(0, 5) / 2, i, [i]) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, score double, id bigint, place array<int>").repartition(7)
    got = top_n(df, ["g"], [F.desc("score"), F.asc("id")], 3)
    assert sorted((r.id, r.place) for r in got.collect()) == brute(rows, 3)


def test_batches_and_empty(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        df = spark.createDataFrame([("a", 1.0, i) for i in range(9)] + [("b", 1.0, 9)], "g string, score double, id bigint")
        got = top_n(df, ["g"], [F.desc("score"), F.asc("id")], 5)
        assert sorted((r.id, r.place) for r in got.collect()) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (9, 1)]
        assert top_n(df.limit(0), ["g"], [F.asc("id")], 2).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
