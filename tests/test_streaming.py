from skein.session import table
from skein.streaming import messages


def run(df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return df.sparkSession.table(name)


def stream(spark, sf, tmp_path):
    rows = table(spark, sf, "twcs")
    rows.write.parquet(str(tmp_path / "in"))
    return messages.read_messages(spark, str(tmp_path / "in"), rows.schema)


def test_counts_per_day(spark, sf, tmp_path):
    got = run(messages.author_counts(stream(spark, sf, tmp_path), late="0 seconds"), "counts")
    assert 0 < got.groupBy().sum("n").first()[0] <= table(spark, sf, "twcs").count()


def test_replies_meet(spark, sf, tmp_path):
    got = run(messages.replies(stream(spark, sf, tmp_path)), "answered")
    assert got.count() > 0 and got.where("created_at < parent_at").count() == 0
