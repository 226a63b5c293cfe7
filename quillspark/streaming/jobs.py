"""Resumable jobs as Structured Streaming: page batches, segment logs, rolling captions, index refresh."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.sources.documents import SEGMENT


def batches(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_a_batch: int = 20) -> StreamingQuery:
    """Work on what a folder of page files has gained, `files_a_batch` files at a time, and write Parquet.

    Started again after a stop, it goes on where the checkpoint ends; a batch is written once.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return work(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def segment_stream(spark: SparkSession, folder: str) -> DataFrame:
    """s, e, t, file of segment logs as they grow; broken lines are dropped."""
    rows = spark.readStream.schema(SEGMENT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(folder)
    return rows.select("s", "e", "t", "_bad", F.col("_metadata.file_name").alias("file")).filter("_bad is null and e is not null").drop("_bad")


def resume_points(stream: DataFrame) -> DataFrame:
    """Where each log ends so far."""
    return stream.groupBy("file").agg(F.max("e").alias("resume_at"), F.count("*").alias("n"))


def new_words(said: list[str], cue: list[str]) -> list[str]:
    # for plain lists, so that it can be tried without Spark
    """The words of a cue behind its longest beginning that what was said ends with."""
    for k in range(min(len(said), len(cue)), 0, -1):
        if said[len(said) - k :] == cue[:k]:
            return cue[k:]
    return cue


def _merge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    said = list(state.get[0]) if state.exists else []
    rows = pd.concat(list(parts)).sort_values("cue_no")
    out = []
    for no, text in zip(rows["cue_no"], rows["text"]):
        fresh = new_words(said, (text or "").split())
        if fresh:
            out.append((key[0], no, " ".join(fresh)))
        said = (said + fresh)[-200:]  # a cue repeats what came shortly before it; longer cues than this aren't captions
    state.update((said,))
    yield pd.DataFrame(out, columns=["video", "cue_no", "text"])


def rolling_captions(cues: DataFrame) -> DataFrame:
    """video, cue_no, text: what each cue of a stream (video, cue_no, text) adds to those before."""
    return cues.groupBy("video").applyInPandasWithState(_merge, "video string, cue_no long, text string", "said array<string>", "append", GroupStateTimeout.NoTimeout)


def refresh_index(files: DataFrame, build: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Postings of the files that came since the last run, a folder a batch, so that a batch run twice replaces itself."""

    def one(rows: DataFrame, epoch: int) -> None:
        build(rows).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events by window and type, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
