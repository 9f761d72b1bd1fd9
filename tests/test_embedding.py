import pytest
from pyspark.sql import functions as F

from lorekeep.functions import embedding


def test_provider_needs_consent_and_a_key():
    assert embedding.provider({"VOYAGE_API_KEY": "x", "GEMINI_API_KEY": "y"}, True) == ("voyage", 1024)
    assert embedding.provider({"VOYAGE_API_KEY": "x"}) is None and embedding.provider({}, True) is None


def test_registered_functions(spark):
    embedding.register(spark, lambda texts: [[float(len(t)), 1.0] for t in texts])
    df = spark.createDataFrame([("call `do_it` now",), ("x" * 9000,)], "t string")
    df.createOrReplaceTempView("given")
    rows = spark.sql("SELECT extract_tags(t) AS g, embed(t) AS v FROM given").collect()
    assert "do_it" in rows[0].g and rows[1].v == [8000.0, 1.0]


def test_failures_give_nulls_and_cosine(spark):
    def broken(texts):
        raise RuntimeError

    df = spark.createDataFrame([("a",)], "t string").select(embedding.embedder(broken)("t").alias("v"))
    assert df.first().v is None
    r = spark.range(1).select(embedding.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))).alias("c"), embedding.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z")).first()
    assert r.c == pytest.approx(0.96) and r.z is None
