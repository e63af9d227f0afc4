import pytest
from pyspark.sql import functions as F

from reviewlake import schemas
from reviewlake.operators.language import fit_language_profiles
from reviewlake.plans.layers import Layers, run_layers
from reviewlake.streaming.incremental import append_stream, bronze_stream

TOPICS = ["pool", "breakfast", "bathroom", "beach", "parking"]


def bronze(spark):
    rows = []
    for i in range(40):
        good, bad = TOPICS[i % 5], TOPICS[(i + 2) % 5]
        french = i % 4 == 0
        rows.append((
            i, f"Hotel in {['Cairo', 'Luxor', 'Giza'][i % 3]}", f"Hotel {i % 7}", f"R{i}", "Egypt", "3 nights · ", "May",
            "Couple", "Double", f"Reviewed: {i} May 2024",
            f"tres belle {good} vraiment" if french else f"Lovely {good}, really lovely {good}!",
            "No Negative Feedback" if i % 2 else f"The {bad} was dirty and cold", None,
        ))
    # The same review collected twice.
    rows.append((99, *rows[0][1:]))
    return spark.createDataFrame(rows, schemas.BRONZE_REVIEWS)


def profiles(spark):
    return fit_language_profiles(
        spark.createDataFrame(
            [("en", "the pool was lovely really dirty and cold breakfast"), ("fr", "tres belle vraiment magnifique")],
            "lang string, text string",
        ),
        "text",
        "lang",
    )


@pytest.mark.parametrize("parity", [False, True])
def test_run_twice(spark, tmp_path, parity):
    layers = Layers(str(tmp_path / "lake"))

    def translator(texts, langs):
        return [t.replace("tres belle", "very beautiful") for t in texts]

    run = lambda: run_layers(spark, bronze(spark), layers, profiles(spark), translator, parity=parity)
    first = run()
    counts = {r["layer"]: r["rows"] for r in first["counts"].collect()}
    assert counts["bronze"] == 41 and counts["silver"] == (41 if parity else 40)
    load = first["load"].first()
    assert load["ok"] and load["before"] == 0 and load["inserted"] > 20
    gold = spark.read.parquet(layers.gold)
    assert gold.columns == schemas.GOLD_REVIEWS.names
    assert gold.where("positive_tokens IS NULL AND negative_tokens IS NULL").count() == 0
    assert gold.where(F.col("positive_review").contains("beautiful")).count() > 0
    assert gold.where("id IS NULL OR inserted_at IS NULL").count() == 0
    tokens = {r[0] for r in gold.select(F.explode("positive_tokens")).distinct().collect()}
    assert tokens <= set(TOPICS) and tokens
    memory = spark.read.parquet(layers.memory).count()

    second = run()["load"].first()
    # Rows with a NULL key (unknown city) are inserted again in parity mode only.
    unknown = gold.where("city IS NULL").count()
    assert second["inserted"] == (unknown if parity else 0) and second["ok"]
    assert spark.read.parquet(layers.memory).count() == memory


def test_stream_appends_each_review_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    bronze(spark).repartition(3).write.parquet(source)
    silver = bronze(spark).drop("scraped_at").limit(0).withColumn("sentiment_classification", F.lit(1))
    silver.write.parquet(target)

    def drain():
        query = append_stream(
            bronze_stream(spark, source, schemas.BRONZE_REVIEWS, files_per_batch=1).drop("scraped_at"),
            target,
            str(tmp_path / "checkpoint"),
        )
        query.awaitTermination(120)
        assert query.exception() is None
        return spark.read.parquet(target).count()

    assert drain() == 40
    bronze(spark).where("id < 10").write.mode("append").parquet(source)
    assert drain() == 40
    assert spark.read.parquet(target).where("sentiment_classification = -1").count() > 0


def test_repeated_ids_are_refused(spark, tmp_path):
    repeated = bronze(spark).withColumn("id", F.lit(1).cast("long"))
    with pytest.raises(ValueError, match="different values of 'id'"):
        run_layers(spark, repeated, Layers(str(tmp_path / "lake")), profiles(spark))
