"""Retrieval and clustering metrics, reports and audits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written


def first_hit(ranked: DataFrame) -> DataFrame:
    """Rank of the first relevant row per query, 0 if none; ranked has (query_id, rank, relevant)."""
    return ranked.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0)).alias("hit"))


def retrieval(hits: DataFrame, cuts=(1, 5, 10, 20, 50), by: tuple[str, ...] = ()) -> DataFrame:
    """A4 / A5: recall at cuts, MRR, single-target NDCG@50, primary = (R@50 + MRR) / 2."""
    h = F.col("hit")
    recalls = [F.avg(F.when((h > 0) & (h <= k), 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in cuts]
    mrr = F.avg(F.when(h > 0, 1.0 / h).otherwise(0.0))
    ndcg = F.avg(F.when((h > 0) & (h <= 50), 1.0 / F.log2(h + 1.0)).otherwise(0.0))
    r50 = F.avg(F.when((h > 0) & (h <= 50), 1.0).otherwise(0.0))
    out = [F.count("*").alias("n"), *recalls, mrr.alias("mrr"), ndcg.alias("ndcg_50"), (0.5 * r50 + 0.5 * mrr).alias("primary_score")]
    return hits.groupBy(*by).agg(*out)


def average_precision(ranked: DataFrame, relevant_total: DataFrame, depth: int = 100) -> DataFrame:
    """Mean over hits of the running precision, divided by min(relevant, depth)."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("relevant").cast("double")
    p = ranked.where(F.col("rank") <= depth).withColumn("precision", F.sum(hit).over(w) / F.col("rank"))
    got = p.groupBy("query_id").agg(F.sum(F.when(F.col("relevant"), F.col("precision")).otherwise(0.0)).alias("gain"))
    return got.join(relevant_total, "query_id").select("query_id", F.when(F.col("total") > 0, F.col("gain") / F.least("total", F.lit(depth))).otherwise(0.0).alias("ap"))


def graded(ranked: DataFrame, k: int) -> DataFrame:
    """NDCG@k of graded relevance; ranked has (query_id, rank, grade), the ideal is over all its rows."""
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank")
    r = ranked.withColumn("ideal", F.row_number().over(best))
    gain = lambda at: F.sum(F.when(F.col(at) <= k, F.col("grade") / F.log2(F.col(at) + 1.0)).otherwise(0.0))
    return r.groupBy("query_id").agg(gain("rank").alias("dcg"), gain("ideal").alias("idcg")).select("query_id", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def macro_and_weighted(df: DataFrame, fold: str, by: str, value: str) -> DataFrame:
    """Per-fold means, their mean (macro) and the mean over all rows (weighted), by grouping sets."""
    cells = df.groupBy(by, fold).agg(F.avg(value).alias("mean"), F.sum(value).alias("s"), F.count("*").alias("n"))
    return cells.groupBy(by).agg(F.avg("mean").alias("fold_macro"), (F.sum("s") / F.sum("n")).alias("weighted"), F.count("*").alias("folds"))


def silhouette_cosine(df: DataFrame) -> DataFrame:
    """A18, exact and linear: for unit vectors the mean distance to a cluster is 1 - v . (its sum) / size.

    df (id, label, v unit) -> (id, label, silhouette).  Clusters are broadcast in blocks of a fixed number; every row
    meets a block as one matrix product, and its parts of all blocks meet by id.
    """
    from .scan import cluster_blocks, matrix

    sums = df.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("s"))
    clusters = written(sums.join(df.groupBy("label").agg(F.count("*").alias("n")), "label"), "clusters")
    rows, parts = df.select("id", "label", "v"), []
    for block in cluster_blocks(clusters):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            labels, sizes, vectors = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                near, own = matrix(b.column(2)) @ vectors.T, b.column(1).to_numpy()[:, None] == labels[None, :]
                inside = np.where(own, (sizes - near) / np.maximum(sizes - 1, 1), np.nan)
                other = np.where(own, np.inf, 1 - near / sizes)
                has = own.any(axis=1)
                a = pa.array(np.where(has, np.nansum(inside, axis=1), 0.0), mask=~has)
                n = pa.array(np.where(own, sizes, 0).sum(axis=1), mask=~has)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), a, pa.array(other.min(axis=1)), n], ["id", "own", "a", "b", "n"])

        part = written(rows.mapInArrow(run, "id long, own long, a double, b double, n long"), "silhouette")
        shared.unpersist()
        parts.append(part)
    if not parts:
        return rows.select("id", "label", F.lit(0.0).alias("silhouette"))
    per = parts[0]
    for p in parts[1:]:
        per = per.unionByName(p)
    per = per.groupBy("id", "own").agg(F.max("a").alias("a"), F.min("b").alias("b"), F.max("n").alias("n"))
    none = (F.col("n") <= 1) | (F.col("b") == float("inf"))
    return per.select("id", F.col("own").alias("label"), F.when(none, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def bootstrap(values: DataFrame, value: str, draws: int, id_col: str) -> DataFrame:
    """A21, distributed: (draw, mean, n); each draw takes as many values as there are, by a hash of draw and place.

    Rows are numbered inside 1,024 parts of their ids, whose sizes give the parts' first numbers; nulls are no values.
    """
    spark = values.sparkSession
    rows = values.where(F.col(value).isNotNull()).select(id_col, value).withColumn("_p", F.pmod(F.col(id_col).cast("long"), F.lit(1024)))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(id_col, value)) - 1)
    sizes = sorted((r["_p"], r["n"]) for r in rows.groupBy("_p").agg(F.count("*").alias("n")).collect())  # 1,024 at most
    n, first = 0, []
    for p, size in sizes:
        first.append((p, n))
        n += size
    first = spark.createDataFrame(first, "_p long, _first long")
    rows = rows.join(F.broadcast(first), "_p").select((F.col("_first") + F.col("_r")).alias("_k"), value)
    place = F.conv(F.substring(F.md5(F.concat_ws(":", "draw", "i")), 1, 8), 16, 10).cast("long") % max(n, 1)
    picks = spark.range(draws * n).select(F.expr(f"id div {max(n, 1)}").alias("draw"), (F.col("id") % max(n, 1)).alias("i")).select("draw", place.alias("_k"))
    return picks.join(rows, "_k").groupBy("draw").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def fixed_pairs(core: DataFrame) -> DataFrame:
    """(query_id, target) of each label with two rows or more: its two smallest ids."""
    rows = core.where(F.col("id").isNotNull() & F.col("label").isNotNull()).select("id", "label")
    first = rows.groupBy("label").agg(F.min("id").alias("query_id"))
    return rows.join(first, "label").where(F.col("id") > F.col("query_id")).groupBy("query_id").agg(F.min("id").alias("target"))


def pair_precision(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(n_pairs, precision): share of pairs whose target is among the found (query_id, id); 0 without pairs."""
    hit = found.select("query_id", F.col("id").alias("target"), F.lit(1.0).alias("hit"))
    both = pairs.join(hit, ["query_id", "target"], "left")
    return both.agg(F.count("*").alias("n_pairs"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0.0))), F.lit(0.0)).alias("precision"))


def missing_rates(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A4: shares of records (query_found, target_found) whose query, target, or either is missing; number of rankable ones."""
    q, t = F.col("query_found"), F.col("target_found")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return records.groupBy(*by).agg(
        share(~q).alias("query_missing_rate"), share(~t).alias("target_missing_rate"), share(~q | ~t).alias("missing_catalogue_rate"),
        F.count("*").alias("n_pairs"), F.count_if(q & t).alias("n_rankable"),
    )


def graded_metrics(ranked: DataFrame, relevant: DataFrame, recall_cut: int, ndcg_cut: int, total: DataFrame | None = None) -> DataFrame:
    """(query_id, recall, mrr, ndcg) of ranked (query_id, id, rank) by relevant (query_id, id, grade > 0); queries are relevant's.

    With total (query_id, total: number of relevant rows) relevant may have only what is ranked to the cuts, or best of a query.
    """
    r = relevant.withColumn("ideal", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")))
    j = r.join(ranked.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    j = j.withColumn("total", F.count("*").over(Window.partitionBy("query_id"))) if total is None else j.join(total, "query_id")
    gain = lambda at: F.coalesce(F.sum(F.when(F.col(at) <= ndcg_cut, F.col("grade") / F.log2(F.col(at) + 1.0))), F.lit(0.0))
    return j.groupBy("query_id").agg(
        (F.count_if(F.col("rank") <= recall_cut) / F.first("total")).alias("recall"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("mrr"), (gain("rank") / gain("ideal")).alias("ndcg"),
    )


def grouped(metrics: DataFrame, groups: str, values: list[str]) -> DataFrame:
    """(group, queries, means): a record counts once in every group of its array column."""
    flat = metrics.withColumn("group", F.explode(F.array_distinct(groups)))
    return flat.groupBy("group").agg(F.count("*").alias("queries"), *[F.avg(v).alias(v) for v in values])


def sweet_spot(sweep: DataFrame, share: float = 0.95) -> DataFrame:
    """One row (sweet_spot, balance) of a sweep (size, precision, coverage), a few rows by contract.

    sweet_spot is the first size whose coverage has come `share` of its way; balance the size of the largest
    harmonic mean of both, brought to 0..1, the smaller of equals.
    """
    w = Window.partitionBy()
    mm = lambda c: (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + 1e-9)
    s = sweep.withColumn("_c", mm("coverage")).withColumn("_p", mm("precision"))
    f1 = 2 * F.col("_p") * F.col("_c") / (F.col("_p") + F.col("_c") + 1e-9)
    return s.agg(F.coalesce(F.min(F.when(F.col("_c") >= share, F.col("size"))), F.max("size")).alias("sweet_spot"), F.max_by("size", F.struct(f1, -F.col("size"))).alias("balance"))


def f1_report(predicted: DataFrame) -> DataFrame:
    """One row (accuracy, macro_f1, n) of (truth, predicted): labels of either column count, as zero where never right."""
    ok = F.col("truth") == F.col("predicted")
    sides = predicted.select(F.col("truth").alias("label"), ok.cast("long").alias("tp"), (~ok).cast("long").alias("miss")).unionByName(predicted.where(~ok).select(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(1).cast("long").alias("miss")))
    per = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("miss").alias("miss"))
    f1 = per.agg(F.avg(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("miss"))).alias("macro_f1"))
    return predicted.agg(F.avg(ok.cast("double")).alias("accuracy"), F.count("*").alias("n")).crossJoin(f1)  # one row each


def hit_rates(nearest: DataFrame) -> DataFrame:
    """(label, n, rate) of (query_label, label): how often the nearest row has the query's label; a null label is the whole."""
    return nearest.rollup(F.col("query_label").alias("label")).agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("query_label")).cast("double")).alias("rate"))


def suite_flags(recs: DataFrame, depth: int = 5) -> DataFrame:
    """A19, per seed: recs (ord, scene, rank, junk, mashup, same_artist, rec_scene, allowed) -> means of the flags.

    An unknown scene counts as coherent; coherence is over the first `depth` rows, the others over all.
    """
    ok = F.coalesce(F.array_contains("allowed", F.col("rec_scene")), F.lit(True)).cast("double")
    mean = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return recs.groupBy("ord", "scene").agg(F.coalesce(F.avg(F.when(F.col("rank") <= depth, ok)), F.lit(0.0)).alias("coherence"), F.coalesce(F.max(F.when(F.col("rank") == 1, ok)), F.lit(1.0)).alias("top1"), mean("junk"), mean("mashup"), mean("same_artist"))


def suite_report(flags: DataFrame, seeds: DataFrame) -> DataFrame:
    """Per scene and, with a null scene, over all: seeds, seeds found, and the means of the seeds' flags; seeds (ord, scene)."""
    j = seeds.join(flags.drop("scene"), "ord", "left")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    return j.rollup("scene").agg(F.count("*").alias("seeds"), F.count("coherence").alias("found"), *[mean(c) for c in ("coherence", "top1", "junk", "mashup", "same_artist")])


def compared(base: DataFrame, test: DataFrame, gain: float = 0.20, guard: float = -0.10) -> DataFrame:
    """One row (absolute, relative, passes_gain, passes_guard) of per-scene scores (scene, score, n) of two reports."""
    b = base.select("scene", F.col("score").alias("x"), F.col("n").alias("nx"))
    t = test.select("scene", F.col("score").alias("y"), F.col("n").alias("ny"))
    change = F.when(F.col("x") > 0, (F.col("y") - F.col("x")) / F.nullif(F.col("x"), F.lit(0.0))).otherwise(F.when(F.col("y") == 0, 0.0).otherwise(1.0))
    both = b.join(t, "scene", "full")
    mean = lambda v, n: F.sum(F.col(v) * F.col(n)) / F.sum(n)
    r = both.agg(mean("x", "nx").alias("x"), mean("y", "ny").alias("y"), F.coalesce(F.bool_and(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), change >= guard)), F.lit(True)).alias("passes_guard"))
    rel = (F.col("y") - F.col("x")) / (F.col("x") + 1e-12)
    return r.select((F.col("y") - F.col("x")).alias("absolute"), rel.alias("relative"), (rel >= gain).alias("passes_gain"), "passes_guard")


def paired_changes(pairs: DataFrame) -> DataFrame:
    """One row (mean_delta, improved, regressed, unchanged) of (base, test)."""
    d = F.col("test") - F.col("base")
    return pairs.agg(F.avg(d).alias("mean_delta"), F.count_if(d > 1e-12).alias("improved"), F.count_if(d < -1e-12).alias("regressed"), F.count_if(F.abs(d) <= 1e-12).alias("unchanged"))


def unequal_ids(key: str, *tables: DataFrame) -> DataFrame:
    """(key, tables that hold it) of the keys that not all tables hold."""
    rows = None
    for k, t in enumerate(tables):
        one = t.select(key, F.lit(k).alias("_t")).distinct()
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("_t")).alias("tables")).where(F.size("tables") < len(tables))


def judged(base: DataFrame, test: DataFrame, judgments: DataFrame) -> DataFrame:
    """Per pair (pair_id, scene, base, test): half the pair's contribution, half the direct judgment.

    base, test (pair_id, scene, contribution), judgments (pair_id, baseline_pass, winner_pass) must hold the same ids.
    """
    odd = unequal_ids("pair_id", base, test, judgments).limit(5).collect()
    if odd:
        raise ValueError(f"judgments and ranked pairs differ in their ids: {[r.pair_id for r in odd]}")
    j = base.select("pair_id", "scene", F.col("contribution").alias("b")).join(test.select("pair_id", F.col("contribution").alias("t")), "pair_id").join(judgments, "pair_id")
    half = lambda a, p: 0.5 * F.col(a) + 0.5 * F.col(p).cast("double")
    return j.select("pair_id", "scene", half("b", "baseline_pass").alias("base"), half("t", "winner_pass").alias("test"))


def contribution(rank, cut: int = 50):
    """Half a hit in the first `cut`, half the reciprocal rank; rank 0 is a miss."""
    return 0.5 * F.when((rank > 0) & (rank <= cut), 1.0).otherwise(0.0) + 0.5 * F.when(rank > 0, 1.0 / F.nullif(rank, F.lit(0))).otherwise(0.0)


def envelope_violations(cells: DataFrame, expected: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, problem) of result cells that are missing, unexpected, repeated, or hold a metric that is null or outside 0..1."""
    many = cells.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.bool_or(F.col(m).isNull() | F.isnan(m) | (F.col(m) < 0) | (F.col(m) > 1)).alias(m) for m in metrics])
    j = expected.select(*keys, F.lit(True).alias("_e")).join(many, keys, "full")
    wrong = F.filter(F.array(*[F.when(F.col(m), F.lit(f"{m} out of range")) for m in metrics]), lambda x: x.isNotNull())
    problems = F.when(F.col("_n").isNull(), F.array(F.lit("missing"))).otherwise(F.concat(F.when(F.col("_e").isNull(), F.array(F.lit("unexpected"))).otherwise(F.array().cast("array<string>")), F.when(F.col("_n") > 1, F.array(F.lit("repeated"))).otherwise(F.array().cast("array<string>")), wrong))
    return j.select(*keys, F.explode(problems).alias("problem"))


def section_limits(counts: DataFrame, budget: int) -> DataFrame:
    """Per kind of section the least, median and most windows selected, and how many tracks repeat some for the budget."""
    n = F.col("n")
    return counts.groupBy("kind").agg(F.min(n).alias("least"), F.percentile(n, 0.5).alias("median"), F.max(n).alias("most"), F.count_if(n < budget).alias("repeating"), F.count("*").alias("tracks"))


def external_overlap(ranked: DataFrame, truth: DataFrame, depth: int = 15) -> DataFrame:
    """(source, queries, overlap): per source of truth (source, query_id, artist), the mean share of the first `depth` rows whose artist it holds."""
    rows = ranked.where(F.col("rank") <= depth).select("query_id", "artist")
    asked = truth.select("source", "query_id").distinct()
    held = truth.select("source", "query_id", "artist", F.lit(1.0).alias("_in")).distinct()
    j = asked.join(rows, "query_id").join(held, ["source", "query_id", "artist"], "left")
    per = j.groupBy("source", "query_id").agg(F.avg(F.coalesce("_in", F.lit(0.0))).alias("overlap"))
    return per.groupBy("source").agg(F.count("*").alias("queries"), F.avg("overlap").alias("overlap"))


def split_leaks(rows: DataFrame, part: str, *keys: str) -> DataFrame:
    """(key, value, parts) of values that stand in several parts of a split."""
    flat = rows.select(part, F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])))
    return flat.where(F.col("value").isNotNull()).groupBy("key", "value").agg(F.array_sort(F.collect_set(part)).alias("parts")).where(F.size("parts") > 1)
