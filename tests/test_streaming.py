"""The streamed log gives the rows that the batch log gives."""

from pyspark.sql import functions as F

from loomtext.sources.tables import log_view
from loomtext.streaming import eventlog


def drained(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return sorted(map(tuple, df.sparkSession.table(name).collect()))


def test_streamed_counts(spark, sf_dir, tmp_path):
    log = log_view(spark, sf_dir).select("loop", "line", "event", "value", "ts", "supersedes")
    log.repartition(3).write.parquet(f"{tmp_path}/log")
    stream = eventlog.read_log(spark, f"{tmp_path}/log")
    want = log.groupBy("loop").agg(F.count(F.when(F.col("event") != "correction", 1)), F.count("supersedes"))
    assert drained(eventlog.net_counts(stream), "net", "complete") == sorted(map(tuple, want.collect()))
    hours = log.groupBy(F.window("ts", "1 hour").alias("w"), "event").count().select("w.start", "event", "count")
    assert drained(eventlog.counts_by_window(stream), "hours", "complete") == sorted(map(tuple, hours.collect()))
    joined = log.alias("l").join(log.alias("c"), F.expr("l.event <> 'correction' AND c.event = 'correction' AND c.loop = l.loop AND c.supersedes = l.line AND c.line > l.line AND abs(datediff(c.ts, l.ts)) < 30"))
    assert drained(eventlog.voided_lines(stream, "60 days"), "voided", "append") == sorted(map(tuple, joined.select("l.loop", "l.line", "c.line").collect()))
