"""The stateless scoring plan gives the same rows on a stream as in batch."""

import os
import shutil

from paths import SF_SMALL
from lurescan.sources.tables import table
from lurescan.streaming.scoring import score_frame, score_stream


def test_stream_equals_batch(spark, tmpdir_session):
    src = os.path.join(tmpdir_session, "inbox")
    os.makedirs(src, exist_ok=True)
    shutil.copy(f"{SF_SMALL}/documents.parquet", os.path.join(src, "part-0.parquet"))
    q = (score_stream(spark, src).writeStream.format("memory").queryName("scored_stream")
         .option("checkpointLocation", os.path.join(tmpdir_session, "stream-ckpt")).outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    streamed = sorted(tuple(r) for r in spark.sql("SELECT * FROM scored_stream").collect())
    batch = sorted(tuple(r) for r in score_frame(table(spark, SF_SMALL, "documents")).collect())
    assert streamed == batch and len(batch) == 200
