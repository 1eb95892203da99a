"""Structured Streaming: ingestion without repeats, counts of run events by time, last access, numbers across batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_sources(stream: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """Sources with content not seen within the delay; the state is bounded by it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["sha256"])


def ingest_stream(stream: DataFrame, corpus, checkpoint: str, policy: str = "discard") -> StreamingQuery:
    """Every micro-batch is ingested as a batch; what the corpus has already is discarded, so a repeated batch changes nothing."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: corpus.ingest(batch, policy)).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """n and total per window and kind; works on streams and tables."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def last_access(events: DataFrame, root: str = "root", time: str = "at") -> DataFrame:
    """The latest access of each corpus, for report.inactive; a stream gives it in update or complete mode."""
    return events.groupBy(root).agg(F.date_format(F.max(time), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("last_accessed_at"))


def number_pages(pages: DataFrame, quiet: str = "1 hour") -> DataFrame:
    """pages: document_id, page_index, sentences (how many), at. first: the number of a page's first sentence in its
    document, counted on across micro-batches in which the pages of several documents come mixed, but each document's in
    order. A document's counter is dropped once no page of it came for so long."""
    ms = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        d = pd.concat(list(frames)).sort_values("page_index", kind="stable")
        first = n + d["sentences"].cumsum() - d["sentences"]
        state.update((int(n + d["sentences"].sum()),))
        state.setTimeoutDuration(ms)
        yield pd.DataFrame({"document_id": key[0], "page_index": d["page_index"], "first": first})

    return pages.groupBy("document_id").applyInPandasWithState(count, "document_id string, page_index bigint, first bigint", "n bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)
