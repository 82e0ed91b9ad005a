"""The content engine as one object: songs in, similar songs out (SC1, V1, V2, V20, T1, J1, J2, A1, UD4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import text
from .operators import linear, resolve
from .sources import ingest


class Songs:
    """Songs of a CSV, or a DataFrame with title, artist and the features; rows are numbered by `row`.

    The keys, the standardised features and all rankings are lazy tables of the session.
    """

    def __init__(self, rows: DataFrame, scoring: config.Scoring | None = None) -> None:
        self.scoring = scoring or config.Scoring()
        missing = [c for c in ("title", *self.scoring.features) if c not in rows.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        rows = rows if "row" in rows.columns else rows.withColumn("row", F.monotonically_increasing_id())
        self.rows = ingest.with_keys(rows if "artist" in rows.columns else rows.withColumn("artist", F.lit("")))

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, scoring: config.Scoring | None = None) -> Songs:
        return cls(ingest.read_songs(spark, path, config.HEADERS, list(config.FEATURES)), scoring)

    def vectors(self) -> DataFrame:
        """V1: the standardised, weighted features as `v`."""
        return linear.standardized(self.rows, list(self.scoring.features), self.scoring.weights)

    def find(self, seeds: list[tuple[str, str | None]]) -> DataFrame:
        """(ord, row) of (title, artist) seeds."""
        spark = self.rows.sparkSession
        told = spark.createDataFrame([(k, t, a) for k, (t, a) in enumerate(seeds)], "ord long, title string, artist string")
        told = told.select("ord", text.song_key(F.col("title")).alias("t"), text.song_key(F.coalesce("artist", F.lit(""))).alias("a"))
        keys = self.rows.select("row", "title_key", "artist_key", text.song_key(F.col("artist")).alias("full_artist"))
        return resolve.find_songs(told, keys)

    def _score(self, at: list[str]) -> Column:
        v, n = F.col("v"), len(self.scoring.features)
        x = [F.get(v, F.lit(k)) for k in range(n)]
        if self.scoring.metric == "euclidean":
            return 1 / (1 + F.sqrt(sum((F.pow(a - F.col(c), F.lit(2)) for a, c in zip(x, at, strict=True)), F.lit(0.0))))
        dot = sum((a * F.col(c) for a, c in zip(x, at, strict=True)), F.lit(0.0))
        long = F.sqrt(sum((a * a for a in x), F.lit(0.0))) * F.sqrt(sum((F.col(c) * F.col(c) for c in at), F.lit(0.0)))
        return F.coalesce(F.try_divide(dot, long), F.lit(0.0))

    def similar(self, seeds: list[tuple[str, str | None]], n: int = 10, *, same_artist: bool = True) -> DataFrame:
        """(rank, row, title, artist, score): the nearest songs to the centroid of the seeds found, without them.

        Of songs that share title and artist the best one counts; same_artist=False leaves the seeds' artists out.
        """
        z = self.vectors()
        found = F.broadcast(self.find(seeds).select("row").distinct())  # the seeds of a call
        mine = z.join(found, "row")
        at = [f"_p{k}" for k in range(len(self.scoring.features))]
        centre = mine.agg(*[F.avg(F.get("v", F.lit(k))).alias(c) for k, c in enumerate(at)])
        others = z.join(F.broadcast(mine.select("dedup_key").distinct()), "dedup_key", "left_anti")  # at most a key per seed
        if not same_artist:
            others = others.join(F.broadcast(mine.select("artist_key").distinct()), "artist_key", "left_anti")
        scored = others.crossJoin(F.broadcast(centre)).where(F.col(at[0]).isNotNull()).withColumn("score", F.round(self._score(at), 6))  # one row
        best = scored.groupBy("dedup_key").agg(F.max_by(F.struct("row", "title", "artist", "score"), F.struct("score", -F.col("row"))).alias("s")).select("s.*")
        top = best.orderBy(F.desc("score"), "row").limit(n)
        from pyspark.sql import Window

        return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "row")).alias("rank"), "row", "title", "artist", "score")

    def unmatched(self, seeds: list[tuple[str, str | None]]) -> list[int]:
        """Places of the seeds without a song."""
        found = {r.ord for r in self.find(seeds).collect()}  # a row per seed
        return [k for k in range(len(seeds)) if k not in found]

    def stats(self) -> DataFrame:
        """A1."""
        return linear.feature_stats(self.rows, list(self.scoring.features), "row")
