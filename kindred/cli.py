"""Command line (UI1): python -m kindred.cli <command>.

    similar   songs like one song            profile   songs like a list of them
    stats     features of a song table       search    songs by a text
    queries   registered queries             run       a query over a data folder, shown or written
"""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kindred", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def songs(name: str):
        c = sub.add_parser(name)
        c.add_argument("songs", help="CSV with titles, artists and features")
        c.add_argument("-n", type=int, default=10)
        return c

    for name in ("similar", "profile"):
        c = songs(name)
        c.add_argument("seed", nargs="+" if name == "profile" else None, help="`title - artist`, or a title" if name == "similar" else "seeds, or files of seeds")
        c.add_argument("--features", help="names with commas between")
        c.add_argument("--weight", action="append", default=[], metavar="NAME=VALUE")
        c.add_argument("--metric", default="euclidean", choices=("euclidean", "cosine"))
        c.add_argument("--other-artists", action="store_true", help="leave the seeds' artists out")
    songs("stats")
    songs("search").add_argument("text")
    sub.add_parser("queries")
    c = sub.add_parser("run")
    c.add_argument("query")
    c.add_argument("data", help="folder of the tables")
    c.add_argument("--out", help="Parquet path; shown without")
    c.add_argument("--explain", action="store_true")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """UI1."""
    told = parser().parse_args(argv)
    if told.command == "queries":
        from kindred.plans import catalogue

        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = spark or SparkSession.builder.appName("kindred").getOrCreate()
    if told.command == "run":
        from kindred.plans import catalogue

        if told.query not in catalogue.QUERIES:
            print(f"no query {told.query}", file=sys.stderr)
            return 2
        found = catalogue.QUERIES[told.query](spark, told.data)
        if told.explain:
            found.explain("formatted")
        elif told.out:
            found.write.parquet(told.out)
        else:
            found.show(50, truncate=80)
        return 0
    from kindred import config
    from kindred.engine import Songs
    from kindred.functions.text import song_key
    from kindred.operators import resolve
    from kindred.sources import ingest

    if told.command == "search":
        rows = Songs.from_csv(spark, told.songs).rows
        keys = rows.select("row", F.col("title_key").alias("title"), song_key(F.col("artist")).alias("artist"))
        resolve.search(keys, told.text, told.n).show(told.n, truncate=80)
        return 0
    if told.command == "stats":
        Songs.from_csv(spark, told.songs).stats().show(truncate=80)
        return 0
    scoring = config.Scoring(tuple(config.feature(f) for f in told.features.split(",")) if told.features else config.FEATURES, config.weights(told.weight), told.metric)
    said = [told.seed] if isinstance(told.seed, str) else told.seed
    seeds = []
    for s in said:
        if s.endswith(".csv"):
            rows = ingest.seed_table(spark, s)
        elif s.endswith(".txt"):
            rows = ingest.seeds(spark.read.text(s, wholetext=True))
        else:
            rows = ingest.seeds(spark.createDataFrame([(s,)], "value string"))
        seeds += [(r.title, r.artist) for r in rows.collect()]  # one user's list
    songs = Songs.from_csv(spark, told.songs, scoring)
    for k in songs.unmatched(seeds):
        print(f"not found: {seeds[k][0]}", file=sys.stderr)
    songs.similar(seeds, told.n, same_artist=not told.other_artists).show(told.n, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
