import datetime

from tracelight.plans.registry import table
from tracelight.streaming.scan_stream import counted, matched


def test_arriving_documents(spark, sf_dir, tmp_path):
    docs, passages = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    start = datetime.datetime(2024, 1, 1)
    stamped = docs.selectExpr("doc_id", "text", f"timestamp'{start}' + make_interval(0, 0, 0, 0, 0, 0, doc_id) AS at")
    for part in range(2):
        stamped.where(f"doc_id % 2 = {part}").write.mode("append").parquet(str(tmp_path / "in"))
    arriving = lambda: spark.readStream.schema(stamped.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))

    def ran(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    pairs = {(r.item_id, r.doc_id) for r in ran(matched(arriving(), passages), "tl_pairs", "append").collect()}
    from tracelight.plans.scan_queries import found

    assert pairs == {(r.site, r.seq) for r in found(spark, sf_dir).collect()}
    totals = ran(counted(arriving(), passages), "tl_totals", "complete")
    assert totals.selectExpr("sum(documents)").first()[0] == len(pairs)
