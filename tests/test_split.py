"""Good and failed rows: counts add up through repeated batches, retries and a stream that fails once."""

import pytest
from pyspark.sql import functions as F

from tessera.sources.split import Split, checked

SCHEMA = "question string, n int"
TEXTS = ['{"question": "a", "n": 1}', '{"question": "b", "n": "x"}', '{"question": " "}', "not json", None, '{"n": 2}', '[{"question": "c"}]', '{"question": "d", "n": null, "more": 1}', '{"question": "e"', ""]


def test_what_is_good(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = {r.id: (r.error, r.record and tuple(r.record)) for r in checked(rows, "text", SCHEMA, ["question"]).collect()}
    bad = "not such an object"
    assert got == {0: (None, ("a", 1)), 1: (bad, None), 2: ("no question", None), 3: (bad, None), 4: ("no text", None), 5: ("no question", None), 6: (bad, None), 7: (None, ("d", None)), 8: (bad, None), 9: (bad, None)}


def test_batches_count_once_and_retries_add_up(spark, tmp_path):
    rows = spark.createDataFrame(list(enumerate(TEXTS * 3)), "id long, text string")
    split = Split(spark, f"{tmp_path}/s", "id")
    check = lambda df: checked(df, "text", SCHEMA, ["question"])
    assert split.good() is None and split.remaining(rows).count() == 30 and not split.retry("r", check)
    assert split.put(1, check(rows.where("id < 12"))) and not split.put(1, check(rows.where("id < 12")))
    assert split.remaining(rows).count() == 18
    with pytest.raises(Exception, match="lost"):
        split.put(2, check(split.remaining(rows)).withColumn("error", F.when(F.col("id") == 20, F.raise_error(F.lit("lost"))).otherwise(F.col("error"))))
    assert split.put(2, check(split.remaining(rows))) and split.remaining(rows).count() == 0
    assert (split.good().count(), split.failed().count()) == (6, 24)
    assert split.retry("again", lambda df: check(df.withColumn("text", F.when(F.col("text") == "not json", F.lit('{"question": "now"}')).otherwise(F.col("text")))))
    assert (split.good().count(), split.failed().count()) == (9, 21) and split.done() == ["1", "2", "again"]
    assert {r.attempt for r in split.failed().collect()} == {2} and {r.record.question for r in split.good().where("attempt = 2").collect()} == {"now"}


def test_a_stream_that_fails_once(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(10 * k + i, t) for i, t in enumerate(TEXTS)], "id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    split, fail = Split(spark, f"{tmp_path}/s", "id"), [True]

    def attempt(df):
        out = checked(df, "text", SCHEMA, ["question"])
        if len(split.done()) == 1 and fail.pop():
            split.put("stream-000000000001", out)  # the batch was written, then the query died
            raise RuntimeError("died")
        return out

    def run():
        stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = split.follow(stream, f"{tmp_path}/c", attempt)
        query.awaitTermination(120)

    with pytest.raises(Exception, match="died"):
        run()
    run()
    assert (split.good().count(), split.failed().count()) == (6, 24) and len(split.done()) == 3
