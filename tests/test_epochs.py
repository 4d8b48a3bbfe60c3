from pressmill.session import checkpoint_dir
from pressmill.streaming.epochs import EpochTable
from pressmill.streaming.seen import SeenUrls


def test_epochs_without_rows_in_folders_by_a_column(spark):
    table = EpochTable(spark, f"{checkpoint_dir(spark)}/epochs-empty", every=2)
    none = spark.createDataFrame([], "url string, bucket int")
    table.write(0, none, by="bucket")
    assert table.before(1) is None
    table.write(1, none, by="bucket")  # completes a base without rows
    table.write(1, none, by="bucket")  # replayed
    table.write(2, spark.createDataFrame([("a", 1)], "url string, bucket int"), by="bucket")
    table.write(3, none, by="bucket")
    assert [r["url"] for r in table.now().collect()] == ["a"]


def test_no_url_met_before_any_was_added(spark):
    seen = SeenUrls(spark, f"{checkpoint_dir(spark)}/seen-empty")
    urls = spark.createDataFrame([("a",), (None,)], "url string")
    seen.add(0, urls.limit(0))
    assert seen.met(1, urls) == (None, [])
