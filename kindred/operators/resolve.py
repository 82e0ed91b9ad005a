"""Search and entity resolution.

Catalogues have (row, title, artist) and whatever keys a look-up needs, seeds (ord, title, artist).  Look-ups
by containment compare the distinct keys of both sides: rows with equal keys are one class, whose best row
answers, and seeds that ask for the same are answered once.  What equi-joins leave over is looked for by
containment.  Of several rows the first in the stated order is taken; ties go to the smaller row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.storage import written

#: Characters of the runs by which parts of titles are looked up.
GRAM = 3


def _first(df: DataFrame, *order, by: str = "ord") -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def search(catalogue: DataFrame, query: str, limit: int) -> DataFrame:
    """Classes exact, prefix, part of title, part of title + artist, all words; then title length, then row.

    catalogue (row, title, artist) with plain lower-case keys; first row of each title and artist.
    """
    q = " ".join(query.lower().split())
    both = F.concat_ws(" ", "title", "artist")
    words = F.forall(F.array(*[F.lit(w) for w in q.split(" ")]), lambda w: F.contains(both, w))
    rank = F.when(F.col("title") == q, 0).when(F.startswith("title", F.lit(q)), 1).when(F.contains("title", F.lit(q)), 2).when(F.contains(both, F.lit(q)), 3).when(words, 4)
    found = catalogue.withColumn("class", rank.cast("long")).where(F.col("class").isNotNull())
    w = Window.partitionBy("title", "artist").orderBy("class", F.length("title"), "row")
    found = found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return found.orderBy("class", F.length("title"), "row").limit(limit)


def _penalty(title: Column) -> list[Column]:
    p = text.version_penalty(title)
    return [p["derivative"], p["size"], F.col("row")]


def _grams(c: str) -> Column:
    return F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (GRAM - 1)), lambda i: F.substring(F.col(c), i, F.lit(GRAM)))))


def holders(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(t, title_key): all pairs of a text t of parts and a text title_key of wholes that holds it; both tables have no text twice.

    A part of GRAM characters or more is looked for where its rarest run of GRAM characters is, a shorter one everywhere.
    """
    held = F.contains("title_key", F.col("t"))
    posted = wholes.where(F.length("title_key") >= GRAM).select("title_key", _grams("title_key").alias("_gram"))
    often = posted.groupBy("_gram").agg(F.count("*").alias("_n"))
    least = parts.where(F.length("t") >= GRAM).select("t", _grams("t").alias("_gram")).join(often, "_gram", "left")
    rarest = least.groupBy("t").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_g")).where("_g.n > 0").select("t", "_g._gram")
    short = parts.where(F.length("t") < GRAM).join(wholes, held)
    return rarest.join(posted, "_gram").where(held).select("t", "title_key").unionByName(short.select("t", "title_key"))


def _asked(seeds: DataFrame, *fields: str) -> DataFrame:
    """What the seeds ask for, once each: _k, a struct of the fields, beside them; nulls are equal in it."""
    return seeds.select(*fields).distinct().withColumn("_k", F.struct(*fields))


def find_songs(seeds: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(ord, row): rows of the seed's title key, else rows whose title key holds it; of them those of the seed's artist, if there are any.

    seeds (ord, t, a), catalogue (row, title_key, artist_key, full_artist); a null or empty artist narrows nothing.
    """
    own = (F.length("a") > 0) & (F.contains("artist_key", F.col("a")) | F.contains("full_artist", F.col("a")))
    kinds = written(catalogue.groupBy("title_key", "artist_key", "full_artist").agg(F.min("row").alias("row")), "kinds")
    titles, asked = kinds.select("title_key").distinct(), _asked(seeds, "t", "a")
    exact = asked.select("t").distinct().join(titles, F.col("t") == F.col("title_key"))
    inside = holders(asked.select("t").distinct().join(exact, "t", "left_anti"), titles)
    found = exact.withColumn("_exact", F.lit(True)).unionByName(inside.withColumn("_exact", F.lit(False)))
    found = asked.join(found, "t").join(kinds, "title_key")
    best = found.groupBy("_k", "_exact").agg(F.min(F.struct(~F.coalesce(own, F.lit(False)).alias("other"), "row")).alias("_b"))
    answers = seeds.select("ord", F.struct("t", "a").alias("_k")).join(best, "_k")
    return _first(answers, F.desc("_exact"), "_b").select("ord", "_b.row")


def resolve_profile(seeds: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ord, row) of the seeds found, the first of those that share a row, and (ord, t, a) of the others."""
    found = written(find_songs(seeds, catalogue), "found")
    return found.groupBy("row").agg(F.min("ord").alias("ord")).select("ord", "row"), seeds.join(found, "ord", "left_anti")


def pair_index(catalogue: DataFrame) -> DataFrame:
    """(title_key, artist_key, row): the best row of each title and primary artist."""
    return _first(catalogue.withColumn("_k", F.struct("title_key", "artist_key")), *_penalty(F.col("title")), by="_k").select("title_key", "artist_key", "row")


def find_row(seeds: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(ord, row, stage).  Stage 0: the best row of title and primary artist; 1, without an artist: the best of the title;
    2: the first of the title whose artist holds the seed's; 3: the first whose title holds the seed's, likewise; 4: none.

    seeds (ord, t, a, p: primary artist), catalogue (row, title, title_key, artist_key, full_artist).
    """
    best = F.struct(*(c.alias(n) for c, n in zip(_penalty(F.col("title")), ("derivative", "size", "row"), strict=True)))
    kinds = written(catalogue.groupBy("title_key", "artist_key", "full_artist").agg(F.min(best).alias("_b"), F.min("row").alias("row")), "kinds")
    pairs = kinds.groupBy("title_key", "artist_key").agg(F.min("_b").alias("_b"))
    titles = pairs.groupBy("title_key").agg(F.min("_b").alias("_b"))
    asked, named = _asked(seeds, "t", "a", "p"), F.coalesce(F.length("a"), F.lit(0)) > 0
    pair = asked.where(F.length("p") > 0).join(pairs, (F.col("t") == F.col("title_key")) & (F.col("p") == F.col("artist_key")))
    alone = asked.where(~named).join(titles, F.col("t") == F.col("title_key"))
    done = pair.select("_k", F.lit(0).alias("stage"), "_b.row").unionByName(alone.select("_k", F.lit(1).alias("stage"), "_b.row"))
    left = asked.join(done, "_k", "left_anti").where(F.length("t") > 0)
    loose = left.join(holders(left.select("t").distinct(), titles.select("title_key")), "t").join(kinds, "title_key").where(~named | F.contains("full_artist", F.col("a")))
    loose = loose.select("_k", F.when(F.col("t") == F.col("title_key"), 2).otherwise(3).alias("stage"), "row")
    return _with_missing(seeds, _answers(seeds, done.unionByName(loose), "t", "a", "p"), 4)


def _answers(seeds: DataFrame, found: DataFrame, *fields: str) -> DataFrame:
    """(ord, stage, row): for every seed the least (stage, row) found for what it asks, (_k, stage, row)."""
    best = found.groupBy("_k").agg(F.min(F.struct("stage", "row")).alias("_b"))
    return _first(seeds.select("ord", F.struct(*fields).alias("_k")).join(best, "_k"), "_b").select("ord", "_b.stage", "_b.row")


def _with_missing(seeds: DataFrame, found: DataFrame, stage: int) -> DataFrame:
    return seeds.select("ord").join(found, "ord", "left").select("ord", "row", F.coalesce("stage", F.lit(stage)).cast("long").alias("stage"))


def unique_row(seeds: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(ord, row, stage): the best row of title and whole artist; without an artist the title's row if it has only one."""
    keyed = catalogue.withColumn("_many", F.count("*").over(Window.partitionBy("title_key")))
    named = F.coalesce(F.length("a"), F.lit(0)) > 0
    pair = _first(seeds.where(named).join(keyed, (F.col("t") == F.col("title_key")) & (F.col("a") == F.col("full_artist"))), *_penalty(F.col("title")))
    alone = seeds.where(~named).join(keyed.where("_many = 1"), F.col("t") == F.col("title_key"))
    return _with_missing(seeds, pair.select("ord", "row", F.lit(0).alias("stage")).unionByName(alone.select("ord", "row", F.lit(1).alias("stage"))), 2)


def eval_row(seeds: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(ord, row, stage): title and artist; title and part of the artist; part of the title and of the artist; none."""
    held = (F.coalesce(F.length("p"), F.lit(0)) == 0) | F.contains("artist_key", F.col("p"))
    kinds = written(catalogue.groupBy("title_key", "artist_key").agg(F.min("row").alias("row")), "kinds")
    asked, same = _asked(seeds, "t", "p"), F.coalesce(F.col("p") == F.col("artist_key"), F.lit(False))
    done = asked.join(kinds, F.col("t") == F.col("title_key")).where(same | held).select("_k", F.when(same, 0).otherwise(1).alias("stage"), "row")
    left = asked.join(done, "_k", "left_anti")
    inside = left.join(holders(left.select("t").distinct(), kinds.select("title_key").distinct()), "t").join(kinds, "title_key").where(held)
    return _with_missing(seeds, _answers(seeds, done.unionByName(inside.select("_k", F.lit(2).alias("stage"), "row")), "t", "p"), 3)


def artists_match(tokens: Column, other_tokens: Column, primary: Column, other_primary: Column) -> Column:
    """A credited artist in common; or one primary artist in the other, of four letters or more; or the same first five letters."""
    both = (F.length(primary) > 0) & (F.length(other_primary) > 0)
    shorter = F.least(F.length(primary), F.length(other_primary))
    inside = F.contains(primary, other_primary) | F.contains(other_primary, primary)
    near = F.when(inside, shorter >= 4).otherwise((shorter >= 5) & (F.left(primary, F.lit(5)) == F.left(other_primary, F.lit(5))))
    return F.coalesce(F.arrays_overlap(tokens, other_tokens), F.lit(False)) | F.coalesce(both & near, F.lit(False))


def resolve_pairs(songs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """J7, PF13: (ord, row, query_row, original) of every row that fits a benchmark song; query_row is the best one.

    songs (ord, t, tokens, primary), catalogue (row, title, title_key, tokens, primary): an equi-join on the title, then the artists.
    """
    c = catalogue.withColumnsRenamed({"tokens": "_tokens", "primary": "_primary"})
    found = songs.join(c, F.col("t") == F.col("title_key")).where(artists_match(F.col("tokens"), F.col("_tokens"), F.col("primary"), F.col("_primary")))
    p = text.version_penalty(F.col("title"), text.BENCH_DERIVATIVE)
    best = F.first("row").over(Window.partitionBy("ord").orderBy(p["derivative"], p["size"], "row"))
    return found.select("ord", "row", best.alias("query_row"), text.is_original(F.col("title")).alias("original"))


def served_rows(served: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(ord, row): the catalogue row of a served (id, title, artist), else the first of its id, else null."""
    c = catalogue.select(F.col("id").alias("_id"), F.col("title").alias("_title"), F.col("artist").alias("_artist"), "row")
    found = served.join(c, F.col("id") == F.col("_id"), "left")
    same = F.coalesce((F.col("title") == F.col("_title")) & (F.col("artist") == F.col("_artist")), F.lit(False))
    return _first(found.withColumn("_same", same), F.desc("_same"), "row").select("ord", "row")


def resolve(seeds: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The short cascade: (ord, row, stage): title and artist, title, part of the title, none; originals first.

    seeds (ord, title, artist), catalogue (row, title, artist).
    """
    named = seeds.select("ord", F.col("title").alias("t"), F.col("artist").alias("a"))
    exact = _first(named.join(catalogue, (F.col("t") == F.col("title")) & (F.col("a") == F.col("artist"))), *_penalty(F.col("title"))).select("ord", "row", F.lit(0).alias("stage"))
    left = named.join(exact, "ord", "left_anti")
    by_title = _first(left.join(catalogue, F.col("t") == F.col("title")), *_penalty(F.col("title"))).select("ord", "row", F.lit(1).alias("stage"))
    left = left.join(by_title, "ord", "left_anti")
    inside = _first(left.where(F.length("t") > 0).join(catalogue, F.contains("title", F.col("t"))), *_penalty(F.col("title"))).select("ord", "row", F.lit(2).alias("stage"))
    return _with_missing(seeds, exact.unionByName(by_title).unionByName(inside), 3)
