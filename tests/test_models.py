import inspect

from vigil.operators import answers, models


def test_rows_with_missing_values_are_scored(spark):
    rows = [(i, None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(i % 10), float(i % 3), int(i % 10 > 7), i % 5 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int, held_out boolean")
    got = models.classify(df, ["id"], ["a", "b"], "y").collect()
    assert sorted(r.id for r in got) == list(range(200))


def test_numbers_of_the_reference():
    assert inspect.signature(models.isolation_forest).parameters["trees"].default == 300
    assert inspect.signature(answers.bootstrap).parameters["resamples"].default == 10_000


def test_flat_trees_and_marked_draw(spark):
    """Flat trees give what a walk down each gives; the rows of least hash are the same however they are found."""
    import numpy as np
    from pyspark.sql import functions as F

    r = np.random.default_rng(0)
    x = np.round(r.normal(size=(5000, 3)), 1)
    trees = [models._grow(x[r.choice(5000, 64, replace=False)], r, 6) for _ in range(20)]

    def walk(node, row, depth=0):
        return depth + models.expected_depth(node[0]) if len(node) == 1 else walk(node[2 if row[node[0]] <= node[1] else 3], row, depth + 1)

    assert np.allclose(models._depth_sums([models._flat(t) for t in trees], x), [sum(walk(t, row) for t in trees) for row in x], atol=1e-9)
    assert models._depth_sums([models._flat((4,))], x[:2]).tolist() == [models.expected_depth(4)] * 2
    ids, lot = spark.range(20_000), F.xxhash64(F.lit(3), "id")
    for most in (100, 15_000, 30_000):
        assert [y.id for y in models._least(ids, lot, ["id"], most).collect()] == [y.id for y in ids.orderBy(lot, "id").limit(most).collect()]


def test_forest_of_cells(spark):
    """Rows of equal bins are one cell, so repeating rows adds no work to the trees; sums and splits equal a plain count, and the forest finds what decides the label."""
    import numpy as np
    from pyspark.sql import functions as F

    from vigil.operators import forest

    base = spark.range(400).select("id", (F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.lit(1.0).alias("c"), (F.col("id") % 50 > 30).cast("int").alias("y"), (F.col("id") % 4 == 0).alias("held_out"))
    many = base.join(spark.range(50).select(F.col("id").alias("copy")))
    cuts = forest.thresholds(many, ["a", "b", "c"])
    assert cuts["b"] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0] and cuts["c"] == [] and len(cuts["a"]) == 31
    cells = lambda t: forest.binned(t, cuts).groupBy("_b0", "_b1", "_b2", "y").agg(F.count("*").alias("n")).agg(F.count("*"), F.sum("n")).first()
    assert cells(many)[0] == cells(base)[0] and cells(many)[1] == 50 * 400
    got = models.classify(many, ["id", "copy"], ["a", "b", "c"], "y", "forest").collect()
    assert len(got) == 20_000 and np.mean([r.predicted == r.y for r in got]) > 0.95 and len({(r.id, r.probability) for r in got}) == 400
    sums = np.array([[5, 0], [4, 1], [0, 6], [1, 5]], float)
    column, cut, left, right = forest.best_split(sums, np.array([1.0, 1.0]), [4], np.array([0]), 2)
    assert (column, cut, round(left, 3), round(right, 3)) == (0, 2, 0.1, 0.917)
    assert forest.best_split(sums, np.array([1.0, 1.0]), [4], np.array([0]), 11)[0] == -1


def test_forest_equals_mllib_on_average(spark):
    """Shares of label 1 are close to those of MLlib's forest of the same numbers; the random numbers are other ones."""
    import numpy as np
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    t = spark.range(3000).select("id", *(F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(1000)).cast("double").alias(c) for i, c in enumerate("abc")))
    t = t.withColumn("y", ((F.col("a") + F.col("b") / 2 + F.pmod(F.xxhash64("id"), F.lit(400)) > 900)).cast("int")).withColumn("held_out", F.lit(False)).cache()
    n, ones = t.count(), t.where("y = 1").count()
    x = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(t).withColumn("w", F.when(F.col("y") == 1, n / 2 / ones).otherwise(n / 2 / (n - ones)))
    want = RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="w", numTrees=300, maxDepth=5, minInstancesPerNode=2, seed=1).fit(x).transform(x).select("id", vector_to_array("probability")[1].alias("p"))
    both = models.classify(t, ["id"], ["a", "b", "c"], "y", "forest").join(want, "id").toPandas()
    assert len(both) == n and np.abs(both.probability - both.p).mean() < 0.025 and np.corrcoef(both.probability, both.p)[0, 1] > 0.99
