"""Articles as a stream: once each by url within the lateness bound, states of each article kept in buckets of urls, tables merged by touched partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidesmith.sources import layout


def dedup_stream(stream: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """Rows whose key has not been seen within the watermark; state older than that is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes all that has arrived to Parquet, exactly once, and ends."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)


def upsert_available(stream: DataFrame, path: str, checkpoint: str, rule: Column, key: list[str], changed: list[str], order: list[str]) -> DataFrame:
    """Upserts all that has arrived into the table at path, micro-batch by micro-batch, and returns the table.

    A late revision replaces `changed`; of several rows of a key in one batch the last by `order` counts. A batch writes the partitions of its
    own rows alone (see layout), and one that is run again after a failure writes the same. The first run creates the table.
    """
    spark, schema = stream.sparkSession, stream.schema

    def each(batch: DataFrame, n: int) -> None:
        files = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
            layout.create(spark.createDataFrame([], schema), path, rule)
        layout.upsert_rows(path, batch, schema, rule, key, changed, [F.desc(c) for c in order])

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return layout.read(spark, path, schema).drop(layout.PART)


# --- the states of an article ----------------------------------------------------------------------------------------------

RAW, SKIPPED, DONE, FAILED = "raw", "skipped_no_summary", "mentions_done", "mentions_failed"
_STEP = "url string, status string, step int, at timestamp"


def article_events(articles: DataFrame) -> DataFrame:
    """Events of articles (url, summary, at): whether there is anything to read, which is all that a state needs of a text."""
    return articles.select("url", "at", F.lit(None).cast("boolean").alias("ok"), (F.coalesce(F.btrim("summary"), F.lit("")) != "").alias("readable"))


def outcome_events(outcomes: DataFrame) -> DataFrame:
    """Events of outcomes (url, ok, at)."""
    return outcomes.select("url", "at", "ok", F.lit(None).cast("boolean").alias("readable"))


_STATE = "urls array<string>, statuses array<string>, early array<boolean>, steps array<int>, until array<long>"


def _steps(days: int):
    """State of a bucket, by url: its status, the outcome that came before the article, how many steps it has taken, and when it is forgotten."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, out, known = state.getCurrentWatermarkMs(), [], {}
        if state.exists:
            known = {url: own for url, *own in zip(*state.get)}
        if not state.hasTimedOut:
            events = pd.concat(list(batches))
            touched: dict = {}
            for url, at, ok, readable in events.sort_values(["at", "ok"], na_position="first")[["url", "at", "ok", "readable"]].itertuples(index=False, name=None):
                touched[url] = max(touched.get(url, 0), int(at.timestamp() * 1000))
                status, early, step, until = known.get(url) or (None, None, 0, 0)
                before = status
                if not pd.isna(readable) and status is None:
                    status = RAW if readable else SKIPPED
                    step += 1
                    out.append((url, status, step, at))
                    if status == RAW and early is not None:
                        ok, before = early, RAW
                if not pd.isna(ok) and status is None:
                    early = bool(ok) if early is None else early
                elif not pd.isna(ok) and status == RAW and (before == RAW or early is not None):
                    status = DONE if ok else FAILED
                    step += 1
                    out.append((url, status, step, at))
                known[url] = [status, early, step, until]
            for url, last in touched.items():
                known[url][3] = max(last, mark) + days * 86_400_000
        known = {url: own for url, own in known.items() if own[3] >= mark}
        if known:
            state.update((list(known), *map(list, zip(*known.values()))))
            state.setTimeoutTimestamp(min(own[3] for own in known.values()))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["url", "status", "step", "at"])

    return run


def article_states(events: DataFrame, late: str = "7 days", days: int = 30, buckets: int = 1024) -> DataFrame:
    """(url, status, step, at): each change of a status, from a stream of events (url, at, ok, readable) of both kinds.

    An article begins as raw, or as skipped where it has no summary; its first outcome settles it, and a settled or skipped one never changes
    again. An outcome that comes before its article waits for it. The state of a url, a few bytes, is dropped `days` after its last event.
    States lie in buckets by the hash of the url, as a call of Python for each url would cost more than its work; a micro-batch reads and writes the
    buckets of its own urls alone. One task holds one bucket at a time. Restarts go on from the checkpoint, with the same number of buckets.
    """
    dealt = events.withWatermark("at", late).withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(_steps(days), _STEP, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest_states(steps: DataFrame) -> DataFrame:
    """(url, status): the last step of each url."""
    return steps.groupBy("url").agg(F.max_by("status", "step").alias("status"))
