import time

from pyspark.sql import functions as F

from tessera.llm import lookalike


def test_rows_spelled_alike_are_not_paired(spark):
    n = 100_000
    df = spark.range(n + 1).select("id", F.lit("t").alias("field"), F.when(F.col("id") == n, "Unti\u200btled").otherwise("Untitled").alias("text"))
    lookalike.same_look(df.limit(10), "id", "field", "text").count()
    began = time.time()
    assert lookalike.same_look(df, "id", "field", "text").count() == n
    assert time.time() - began < 30  # pairs of equal spelling alone would be 5 billion
