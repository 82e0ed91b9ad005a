"""Rating snapshots: batch merge and its streaming forms (A27, PF19, PF22, F11, F13, SK8, ST1, ST3, ST4)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_sessions(snapshots: DataFrame) -> DataFrame:
    """(session, key, value, n): snapshots (session, key, value, digest) with equal digests count once;
    a key with several values is a conflict: value null, n the number of values.

    Equal digests have equal contents, so one grouping with the set of values does without a
    shuffle of its own for repeats.
    """
    merged = snapshots.groupBy("session", "key").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value"))
    return merged.select("session", "key", F.when(F.col("n") == 1, F.col("value")).alias("value"), F.col("n").cast("long").alias("n"))


def conflicts(snapshots: DataFrame) -> DataFrame:
    return merge_sessions(snapshots).where(F.col("n") > 1).select("session", "key", "n")


def folded(snapshots: DataFrame) -> DataFrame:
    """(analysis_id, session, ratings: map by key, snapshots, conflicts) per session, numbered S000001, ... in the order of sessions.

    snapshots (session, at, digest, ratings: map); equal digests count once.  The maps are merged in the order of
    (at, digest): later snapshots add keys, and a key that changes its value is a conflict.
    """
    from ..sources.ingest import numbered

    once = snapshots.dropDuplicates(["session", "digest"])
    flat = once.select("session", "at", "digest", F.explode_outer("ratings").alias("key", "value"))
    per = flat.groupBy("session", "key").agg(F.min_by("value", F.struct("at", "digest")).alias("value"), F.count_distinct("value").alias("_n"))
    some = F.col("key").isNotNull()
    merged = per.groupBy("session").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(some, F.struct("key", "value"))))).alias("ratings"),
        F.array_sort(F.collect_list(F.when(F.col("_n") > 1, F.col("key")))).alias("conflicts"),
    )
    merged = merged.join(once.groupBy("session").agg(F.count("*").alias("snapshots")), "session")
    rows = numbered(merged, "session", "_k")
    return rows.select(F.concat(F.lit("S"), F.lpad((F.col("_k") + 1).cast("string"), 6, "0")).alias("analysis_id"), "session", "ratings", "snapshots", "conflicts")


def adds_only(old: Column, new: Column) -> Column:
    """every key of the old map is in the new one, with the same value."""
    return F.forall(F.map_entries(old), lambda e: F.coalesce(F.try_element_at(new, e["key"]) == e["value"], F.lit(False)))


def iso_time(c: Column) -> Column:
    """a UTC time with exactly three fraction digits, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"), F.try_to_timestamp(c))


def valid_rating(start: str, end: str, ms: str) -> Column:
    """PF19: ISO times with exactly three fraction digits, end not before start, duration within a second."""
    span = F.unix_millis(iso_time(F.col(end))) - F.unix_millis(iso_time(F.col(start)))
    return F.coalesce((span >= 0) & (F.abs(span - F.col(ms)) <= 1000), F.lit(False))


def rating_problems(ratings: DataFrame) -> DataFrame:
    """PF19: (session, key, problem) of ratings (session, key, similarity, score, coherence, unrelated, ms, rated_at, started_at, ended_at, duration_ms)."""
    # What a rating may say.
    coherence = ["not_coherent", "somewhat_coherent", "very_coherent"]
    at, a, z = (iso_time(F.col(c)) for c in ("rated_at", "started_at", "ended_at"))
    checks = {
        "score": ~F.coalesce(F.col("score").between(0, 10), F.lit(False)), "coherence": ~F.coalesce(F.col("coherence").isin(coherence), F.lit(False)),
        "unrelated": ~F.coalesce(F.col("unrelated").between(0, 3), F.lit(False)), "time in session": ~F.coalesce((at >= a) & (at <= z), F.lit(False)),
        "interaction": ~F.coalesce((F.col("ms") >= 1) & (F.col("ms") <= F.col("duration_ms")), F.lit(False)), "duration": ~valid_rating("started_at", "ended_at", "duration_ms"),
    }
    wrong = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    return ratings.select("session", "key", F.explode(wrong).alias("problem"))


def normalized(snapshots: DataFrame, key: bytes) -> DataFrame:
    """PF22: snapshots (schema_version, body, hmac, digest, secret, ...) of both versions with `valid`: version 17 by its HMAC of the
    body, version 16 by its digest; columns of secrets are left out."""
    from ..sources.store import hmac_sha256

    good = F.when(F.col("schema_version") == 17, F.col("hmac") == hmac_sha256(key)("body")).when(F.col("schema_version") == 16, F.col("digest") == F.sha2("body", 256)).otherwise(F.lit(False))
    return snapshots.withColumn("valid", F.coalesce(good, F.lit(False))).drop("hmac", "secret", "local_session_key")


def stream_merge(stream: DataFrame, out: str, checkpoint: str, delay: str = "1 day"):
    """ST3: a streaming query (available now) that appends the values seen.

    Redelivered snapshots are dropped while the watermark remembers them; one that comes later is appended
    again, and `merged` counts it once, so late and repeated files change nothing.
    """
    once = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["digest"])

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.select("session", "key", "value", "digest").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return once.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark, out: str) -> DataFrame:
    return merge_sessions(spark.read.option("basePath", out).parquet(out).select("session", "key", "value", "digest"))


def activity(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """ST1: (start, kind, n, value) per tumbling or sliding window of event time; the same on a table and on a stream."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w, "kind").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "kind", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """ST1: (rater, start, end, n): session windows that close after a gap."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "rater").agg(F.count("*").alias("n")).select("rater", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stream_sessions(stream: DataFrame) -> DataFrame:
    """ST1, ST3: a stateful operator: for each batch (session, keys, conflicts) of the sessions it touches.

    State holds the digest of each key's first value, by session: what a session has is bounded by its ratings.
    """

    def step(session, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, conflict = (dict(zip(*state.get[:2], strict=True)), state.get[2]) if state.exists else ({}, 0)
        for pdf in batches:
            for key, value in pdf[["key", "value"]].sort_values(["key", "value"]).itertuples(index=False):
                conflict += seen.setdefault(key, value) != value
        state.update((list(seen), list(seen.values()), conflict))
        yield pd.DataFrame({"session": [session[0]], "keys": [len(seen)], "conflicts": [conflict]})

    return stream.groupBy("session").applyInPandasWithState(step, "session long, keys long, conflicts long", "keys array<string>, vals array<long>, conflicts long", "update", "NoTimeout")


def harvest(found: DataFrame, out: str, checkpoint: str, key: str):
    """ST4: a resumable harvest: each batch of new files is appended without the keys that are there already; runs to the end of what is there."""
    from ..sources import store

    def sink(batch: DataFrame, epoch: int) -> None:
        store.append_new(batch, out, key)

    return found.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
