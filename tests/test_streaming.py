"""Row-local policies give the same result on a streaming source as in batch."""
import tempfile

from apptflow.sources import adapters
from apptflow.streaming.scoring import request_stream, score_requests


def test_stream_matches_batch(spark, sf_small):
    base = adapters.request_base(spark, sf_small)
    src = tempfile.mkdtemp(prefix="apptflow-stream-src-", dir="/tmp")
    base.write.mode("overwrite").parquet(src + "/batch0")
    stream = request_stream(spark, src + "/batch0", base.schema)
    cols = ["patient_id", "reason_text", "is_priority", "baseline_minutes", "heuristic_minutes", "heuristic_class"]
    q = (score_requests(stream).select(*cols).writeStream.format("memory").queryName("scored_requests")
         .outputMode("append").option("checkpointLocation", tempfile.mkdtemp(dir="/tmp")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM scored_requests").collect())
    want = sorted(tuple(r) for r in score_requests(base).select(*cols).collect())
    assert got == want and len(got) > 0
