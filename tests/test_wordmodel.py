"""The classifier on hashed words: held-out accuracy, edge rows, and its use as a sentiment scorer."""

from pyspark.sql import functions as F

from tidemark.operators import text, wordmodel


def test_held_out_accuracy_is_above_the_majority(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet").join(spark.read.parquet(f"{middle}/labels.parquet"), "doc_id")
    held = docs.filter("doc_id % 5 = 0").select("text", F.col("toxic").cast("int").alias("y"))
    model = wordmodel.fit_words(docs.filter("doc_id % 5 != 0"), "text", "toxic")
    got = held.select(((model.scorer()(F.col("text")) > 0).cast("int") == F.col("y")).cast("int").alias("right"), "y").agg(F.avg("right"), F.avg("y")).first()
    assert got[0] > 1.05 * max(got[1], 1 - got[1]) and 0 < len(model.weights) < 500


def test_edge_rows_and_scorer(spark):
    rows = [(i, "good fine words" if i % 2 else "awful bad words", i % 2) for i in range(200)] + [(900, None, 1), (901, "", 0), (902, "good", None)]
    df = spark.createDataFrame(rows, "id long, text string, y int")
    model = wordmodel.fit_words(df, "text", "y")
    new = spark.createDataFrame([(1, "Good, FINE!"), (2, "bad; awful"), (3, None), (4, "..."), (5, "good awful")], "id long, text string")
    score = {r["id"]: r["s"] for r in new.select("id", model.scorer()(F.col("text")).alias("s")).collect()}
    assert score[1] > 3 and score[2] < -3 and score[3] == score[4] and abs(score[5] - score[3]) < max(abs(score[1]), abs(score[2]))
    other = wordmodel.fit_words(df.withColumn("y", 1 - F.col("y")), "text", "y")
    said = {r["id"]: r["sentiment_score"] for r in text.score_text(new, "text", wordmodel.word_scorer(model, other)).collect()}
    assert said[1] > 0 > said[2] and said[3] == 0.0
    alone = wordmodel.fit_words(df.filter("y = 1"), "text", "y")
    assert len(alone.weights) == 0 and alone.bias > 0
    assert wordmodel.fit_words(df.limit(0), "text", "y").bias == 0.0
