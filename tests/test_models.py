"""Fitted models on small hand-made tables."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from gridloom.operators import models, tuning


def test_boosted_trees_follow_more_steps_than_the_librarys_bins(spark):
    df = spark.range(2000).select("id", (F.col("id") % 100).cast("double").alias("y"))
    fitted = models.train(df, "y", ["id"], "gbt_regressor")
    assert tuning.score(fitted.transform(df), "y", "regression")["r2"] > 0.3


def test_boosted_trees_follow_many_teeth_along_a_column(spark, tmp_path):
    df = spark.range(30000).select("id", (F.xxhash64("id") % 1000).cast("double").alias("noise"), (F.col("id") % 500).cast("double").alias("y"))
    unseen = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    fitted = models.train(df.where(~unseen), "y", ["id", "noise"], "gbt_regressor", maxIter=3)
    assert tuning.score(fitted.transform(df.where(unseen)), "y", "regression")["r2"] > 0.5
    fitted.write().save(f"{tmp_path}/model")
    again = PipelineModel.load(f"{tmp_path}/model").transform(df.limit(20)).select("id", "prediction")
    assert sorted(again.collect()) == sorted(fitted.transform(df.limit(20)).select("id", "prediction").collect())


def test_local_means_are_of_columns_that_say_something_of_the_target(spark):
    df = spark.range(20000).select("id", F.rand(3).alias("noise"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("gaps"), (F.col("id") % 50).alias("few"), F.lit(None).cast("double").alias("none"), (F.col("id") % 400).alias("y"))
    assert models.local_means(df, "y", ["id", "noise", "gaps", "few", "none"])[1] == ["id_local_", "gaps_local_"]
    assert models.local_means(df.limit(0), "y", ["id", "noise"]) == ([], [])
    fitted = models.train(df, "y", ["gaps", "few"], "gbt_regressor", maxIter=2)
    assert fitted.transform(df).count() == df.where("gaps is not null").count()  # as without local means
