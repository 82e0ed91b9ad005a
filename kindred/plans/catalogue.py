"""Registered queries of the engine and their oracle SQL.

Driver tables stand in for catalogue data: embeddings are the library (label = artist), every row
whose id is divisible by 100 is a query; parts are titles with aggregated line items as features;
events are rating snapshots.  Scores are rounded to 6 decimals and ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions import vectors as V
from ..operators import evaluate, graph, late, linear, rank, resolve, sampling
from ..operators.scan import Guard, View, density, top
from ..sources import ingest
from ..sources.storage import written
from ..streaming import ratings

#: Rows of one tag set that are kept together.
CHUNK = 1024
QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None, **parts: str):
    """Registers a query under its name; sql may use {E}, {S}, ... (shared CTEs below)."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql.replace("{E}", E).replace("{S}", S).replace("{FEAT}", FEAT).replace("{EV}", EV)
        return f

    return put


#: Library, queries; cosine scores of all rows (rounded).
E = "e AS (SELECT vec_id id, label::BIGINT label, embedding::DOUBLE[] v FROM embeddings), q AS (SELECT id query_id, label query_label, v qv FROM e WHERE id % 100 = 0)"
S = E + ", s AS (SELECT query_id, query_label, id, label, round(list_cosine_similarity(v, qv), 6) score FROM e, q WHERE id <> query_id)"
FEAT = "f AS (SELECT l_partkey id, avg(l_quantity) a, avg(l_extendedprice) b, avg(l_discount) c, avg(l_tax) d, sum(l_quantity) g, count(*)::DOUBLE h FROM lineitem GROUP BY 1)"
FEATURES = ["a", "b", "c", "d", "g", "h"]
EV = "ev AS (SELECT user_id session, event_type || '-' || (event_id % 50)::VARCHAR AS key, round(value)::BIGINT val, md5(user_id || '/' || event_type || '/' || (event_id % 50) || '/' || round(value)::BIGINT) digest FROM events)"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def library(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), V.doubles(F.col("embedding")).alias("v"))


def asked(lib: DataFrame) -> DataFrame:
    return lib.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "label", "v")


def features(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c: F.col(c)
    return read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.avg(one("l_quantity")).alias("a"), F.avg(one("l_extendedprice")).alias("b"), F.avg(one("l_discount")).alias("c"), F.avg(one("l_tax")).alias("d"), F.sum(one("l_quantity")).alias("g"), F.count("*").cast("double").alias("h"))


def r6(c):
    return F.round(c, 6)


@query("WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE label <> query_label) SELECT query_id, rank, id, score FROM r WHERE rank <= 10")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    """J9, V8, T8, PF5: the ten nearest rows of other labels."""
    lib = library(spark, d)
    return top(lib, asked(lib), 10, not_label=True).select("query_id", "rank", "id", "score")


@query("WITH {E}, s AS (SELECT query_id, id, round(1 / (1 + list_distance(v, qv)), 6) score FROM e, q WHERE id <> query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, rank, id, score FROM r WHERE rank <= 10")
def knn_euclid_score(spark: SparkSession, d: str) -> DataFrame:
    """V2, J9."""
    lib = library(spark, d)
    return top(lib, asked(lib), 10, [View("euclid")]).select("query_id", "rank", "id", "score")


@query("WITH {FEAT}, m AS (SELECT " + ", ".join(f"avg({x}) m{x}, stddev_pop({x}) s{x}" for x in FEATURES) + " FROM f), z AS (SELECT id, " + ", ".join(f"({x} - m{x}) / CASE WHEN s{x} = 0 THEN 1 ELSE s{x} END * sqrt({w}) z{x}" for x, w in zip(FEATURES, (1.5, 1, 1, 1, 1.5, 1))) + " FROM f, m), p AS (SELECT " + ", ".join(f"avg(z{x}) p{x}" for x in FEATURES) + " FROM z WHERE id % 100 = 0), s AS (SELECT id, round(1 / (1 + sqrt(" + " + ".join(f"pow(z{x} - p{x}, 2)" for x in FEATURES) + ")), 6) score FROM z, p WHERE id % 100 <> 0) SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, score FROM s QUALIFY rank <= 20")
def content_profile(spark: SparkSession, d: str) -> DataFrame:
    """V1, V2, V20, PF1, PF4: rows nearest to the centroid of a profile, the profile's own rows left out."""
    z = linear.standardized(features(spark, d), FEATURES, {"a": 1.5, "g": 1.5})
    mine = F.col("id") % 100 == 0
    centre = z.agg(*[F.avg(F.when(mine, F.get("v", F.lit(k)))).alias(f"p{k}") for k in range(len(FEATURES))])
    gap = sum((F.pow(F.get("v", F.lit(k)) - F.col(f"p{k}"), F.lit(2)) for k in range(len(FEATURES))), F.lit(0.0))
    s = z.where(~mine).join(F.broadcast(centre)).select("id", r6(1 / (1 + F.sqrt(gap))).alias("score"))  # one centre
    best = s.orderBy(F.desc("score"), "id").limit(20)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long").alias("rank"), "id", "score")


@query("WITH {FEAT}, u AS (UNPIVOT f ON a, b, c, d, g, h INTO NAME feature VALUE x) SELECT feature, round(min(x), 6) low, round(avg(x), 6) mean, round(max(x), 6) high, round(stddev_samp(x), 6) dev, (SELECT min(id) FROM u w WHERE w.feature = u.feature AND w.x = max(u.x)) top_id FROM u GROUP BY feature")
def feature_stats(spark: SparkSession, d: str) -> DataFrame:
    """A1."""
    s = linear.feature_stats(features(spark, d), FEATURES, "id")
    return s.select("feature", *[r6(F.col(c)).alias(c) for c in ("low", "mean", "high", "dev")], "top_id")


_FUSE = "WITH {E}, s AS (SELECT query_id, query_label, id, label, list_cosine_similarity(v[1:35], qv[1:35]) n, 1 / (1 + list_distance(v[36:64], qv[36:64])) w FROM e, q), b AS (SELECT *, round(0.8 * (n - avg(n) OVER k) / (stddev_pop(n) OVER k + 1e-9) + 0.2 * (w - avg(w) OVER k) / (stddev_pop(w) OVER k + 1e-9), 6) score FROM s WINDOW k AS (PARTITION BY query_id))"
_FUSED = [View("cosine", 0, 35, 0.8), View("euclid", 35, 64, 0.2)]


@query(_FUSE + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b WHERE id <> query_id) SELECT query_id, rank, id, score FROM r WHERE rank <= 15")
def fused_blend(spark: SparkSession, d: str) -> DataFrame:
    """Z-scores over the whole library, exclusions after them."""
    lib = library(spark, d)
    return top(lib, asked(lib), 15, _FUSED, standard=True).select("query_id", "rank", "id", "score")


@query(_FUSE + ", d AS (SELECT *, row_number() OVER (PARTITION BY query_id, id // 2, label ORDER BY score DESC, id) k FROM b WHERE id <> query_id AND label <> query_label), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) j FROM d WHERE k = 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c WHERE j <= 2) SELECT query_id, rank, id, label, score FROM r WHERE rank <= 10")
def guarded_top(spark: SparkSession, d: str) -> DataFrame:
    """The same blend, first of each key (a pair of ids with one label), then two rows of a label, inside the pass."""
    lib = library(spark, d)
    guard = Guard(lambda ids, labels: ids // 2 * 1_000_003 + labels, cap=2)
    return top(lib, asked(lib), 10, _FUSED, standard=True, not_label=True, guard=guard).select("query_id", "rank", "id", "label", "score")


_CENT = ", m AS (SELECT label, i, avg(v[i]) x, count(*) n FROM e, generate_series(1, 64) t(i) GROUP BY 1, 2), c AS (SELECT label, n, list(x ORDER BY i) m, sqrt(sum(x * x)) len FROM m GROUP BY label, n)"


@query("WITH {E}" + _CENT + " SELECT label, n, i - 1 AS pos, round(m[i] / len, 6) x FROM c, generate_series(1, 64) t(i) WHERE n >= 3")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    """V14."""
    c = rank.centroids(library(spark, d), 3)
    return c.select("label", "n", F.posexplode("v").alias("pos", "x")).select("label", "n", F.col("pos").cast("long").alias("pos"), r6(F.col("x")).alias("x"))


@query("WITH {S}" + _CENT + ", p AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 50), g AS (SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p.id) old, list_cosine_similarity(a.m, b.m) genre FROM p JOIN c a ON a.label = p.query_label JOIN c b ON b.label = p.label), h AS (SELECT *, round(0.75 * (score - min(score) OVER k) / (max(score) OVER k - min(score) OVER k + 1e-9) + 0.25 * (genre - min(genre) OVER k) / (max(genre) OVER k - min(genre) OVER k + 1e-9), 6) blend FROM g WINDOW k AS (PARTITION BY query_id)) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN old <= 20 THEN 0 ELSE 1 END, CASE WHEN old <= 20 THEN blend END DESC NULLS LAST, old) AS rank, blend FROM h")
def centroid_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 re-sorted by a blend with the label centroids' similarity."""
    lib = library(spark, d)
    c = rank.centroids(lib).select("label", "v")
    pool = top(lib, asked(lib), 50)
    pool = pool.join(c, "label").join(c.select(F.col("label").alias("query_label"), F.col("v").alias("qv")), "query_label")
    pool = pool.withColumn("genre", V.cosine(F.col("v"), F.col("qv"))).drop("v", "qv")
    pool = pool.withColumn("blend", r6(0.75 * V.minmax(F.col("score"), "query_id") + 0.25 * V.minmax(F.col("genre"), "query_id")))
    return rank.head_resort(pool, "blend").select("query_id", "id", F.col("new_rank").alias("rank"), "blend")


_DUAL = "WITH {E}, s AS (SELECT query_id, query_label, id, label, list_cosine_similarity(v[1:32], qv[1:32]) a, list_cosine_similarity(v[33:64], qv[33:64]) b, (id % 6)::DOUBLE p, (id % 2)::DOUBLE o FROM e, q), z AS (SELECT *, round(0.25 * (a - avg(a) OVER k) / (stddev_pop(a) OVER k + 1e-9) + 0.75 * (b - avg(b) OVER k) / (stddev_pop(b) OVER k + 1e-9) + 0.2 * (p - avg(p) OVER k) / (stddev_pop(p) OVER k + 1e-9) + 0.1 * (o - avg(o) OVER k) / (stddev_pop(o) OVER k + 1e-9), 6) score FROM s WINDOW k AS (PARTITION BY query_id)), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM z WHERE id <> query_id)"


def _dual(spark: SparkSession, d: str, k: int) -> DataFrame:
    lib = library(spark, d).withColumn("p", (F.col("id") % 6).cast("double")).withColumn("o", (F.col("id") % 2).cast("double"))
    views = [View("cosine", 0, 32, 0.25), View("cosine", 32, 64, 0.75), View("prior", weight=0.2, column="p"), View("prior", weight=0.1, column="o")]
    return top(lib, asked(lib), k, views, standard=True)


@query(_DUAL + " SELECT query_id, rank, id, score FROM t WHERE rank <= 10")
def dual_tail(spark: SparkSession, d: str) -> DataFrame:
    """V12."""
    return _dual(spark, d, 10).select("query_id", "rank", "id", "score")


@query(_DUAL + ", c AS (SELECT query_id, id, label, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(v, qv), 6) DESC, id) AS rank FROM e, q WHERE id <> query_id), u AS (SELECT query_id, id, 0 stage, rank pos FROM c WHERE rank <= 5 UNION ALL SELECT query_id, id, 1, rank FROM t WHERE rank <= 20), w AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY stage, pos) = 1) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY stage, pos) AS rank, id, stage::BIGINT stage FROM w QUALIFY rank <= 15")
def guardrail_union(spark: SparkSession, d: str) -> DataFrame:
    """U1."""
    lib = library(spark, d)
    return rank.staged_union([top(lib, asked(lib), 5), _dual(spark, d, 20)], 15).select("query_id", "rank", "id", "stage")


@query(_DUAL + ", c AS (SELECT query_id, id, label, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(v, qv), 6) DESC, id) AS rank FROM e, q WHERE id <> query_id), u AS (SELECT query_id, id, label, 0 stage, rank pos FROM c WHERE rank <= 5 UNION ALL SELECT query_id, id, label, 1, rank FROM t WHERE rank <= 60), w AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY stage, pos) = 1), x AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY stage, pos) k FROM w) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY stage, pos) AS rank, id, stage::BIGINT stage FROM x WHERE k = 1 OR stage = 0 QUALIFY rank <= 12")
def stable_head(spark: SparkSession, d: str) -> DataFrame:
    """The head stays, the tail has no label twice."""
    lib = library(spark, d)
    return rank.staged_union([top(lib, asked(lib), 5), _dual(spark, d, 60)], 12, also="label").select("query_id", "rank", "id", "stage")


@query()
def whitened_knn(spark: SparkSession, d: str) -> DataFrame:
    """V6, V7: no SQL (eigen-decomposition); held against numpy in the tests."""
    white = linear.whitened(library(spark, d), 64)
    return top(white, asked(white), 10, digits=5).select("query_id", "rank", "id", "score")


#: Greedy choice as a recursion over lists: places chosen so far, and each row's largest similarity to them.
_GREEDY = "u AS (SELECT id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-9)) v FROM e), l AS (SELECT query_id, list(p.id ORDER BY n) ids, list(score ORDER BY n) sc, list(u.v ORDER BY n) vs FROM p JOIN u ON u.id = p.id GROUP BY 1), k AS (SELECT *, list_transform(sc, lambda x: (x - list_min(sc)) / (list_max(sc) - list_min(sc) + 1e-9)) rel FROM l), r AS (SELECT query_id, []::BIGINT[] c, list_transform(ids, lambda x: NULL::DOUBLE) near FROM k UNION ALL SELECT query_id, list_append(c, i::BIGINT), list_transform(range(1, len(vs) + 1), lambda j: greatest(coalesce(near[j], -1e9), list_dot_product(vs[j], vs[i]))) FROM (SELECT query_id, c, near, vs, list_position(g, list_max(g)) i FROM (SELECT r.query_id, c, near, vs, list_transform(range(1, len(vs) + 1), lambda j: CASE WHEN list_contains(c, j) THEN -1e9 ELSE 0.85 * rel[j] - 0.15 * coalesce(near[j], 0) END) g FROM r JOIN k ON k.query_id = r.query_id WHERE len(c) < least(15, len(vs))) x) y), z AS (SELECT r.query_id, ids[c[t]] id, sc[c[t]] score, t AS rank FROM r JOIN k ON k.query_id = r.query_id, generate_series(1, 15) x(t) WHERE len(c) = least(15, len(ids)) AND t <= len(c))"


@query("WITH RECURSIVE {S}, p AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) n FROM s QUALIFY n <= 200), " + _GREEDY + " SELECT query_id, id, score, rank FROM z")
def mmr_diverse(spark: SparkSession, d: str) -> DataFrame:
    """Greedy; the SQL recurses over lists."""
    lib = library(spark, d)
    return rank.mmr(top(lib, asked(lib), 200), lib, 15)


@query("WITH {E}, r AS (SELECT id rid, v rv FROM e WHERE id % 100 = 0), m AS (SELECT e.id, max(list_cosine_similarity(v, rv)) top FROM e, r GROUP BY 1) SELECT e.id, round(m.top + ln(avg(exp(8 * (list_cosine_similarity(v, rv) - m.top)))) / 8, 6) density FROM e, r, m WHERE m.id = e.id GROUP BY e.id, m.top")
def hubness(spark: SparkSession, d: str) -> DataFrame:
    """Log-mean-exp of similarities to the references, inside the batches of rows."""
    lib = library(spark, d)
    return density(lib, asked(lib)).select("id", r6(F.col("density")).alias("density"))


@query("WITH {S}, t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20), b AS (SELECT * FROM t WHERE label <> query_label QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3), p AS (SELECT query_id, v FROM b JOIN e USING (id) UNION ALL SELECT query_id, qv FROM q), m AS (SELECT query_id, i, avg(v[i]) x FROM p, generate_series(1, 64) t(i) GROUP BY 1, 2), c AS (SELECT query_id, list(x ORDER BY i) qv FROM m GROUP BY 1), n AS (SELECT query_id, id, round(list_cosine_similarity(v, qv), 6) score FROM e, c WHERE id <> query_id) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM n QUALIFY rank <= 10")
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the query and its three best rows of other labels among the first 20, scored again."""
    lib = library(spark, d)
    q = asked(lib)
    best = rank.ranked(top(lib, q, 20).where(F.col("label") != F.col("query_label")).drop("rank"), F.desc("score"), "id").where(F.col("rank") <= 3)
    parts = best.join(lib.select("id", "v"), "id").select("query_id", "v").unionByName(q.select("query_id", "v"))
    again = V.mean_vector("v", "query_id")(parts).withColumn("label", F.lit(-1).cast("long"))
    return top(lib, again, 10).select("query_id", "rank", "id", "score")


_REL = "WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, label = query_label relevant FROM s)"


def _relevant(spark: SparkSession, d: str, k: int) -> DataFrame:
    lib = library(spark, d)
    return top(lib, asked(lib), k).withColumn("relevant", F.col("label") == F.col("query_label"))


@query(_REL + ", h AS (SELECT query_id, coalesce(min(CASE WHEN relevant AND rank <= 100 THEN rank END), 0) hit FROM r GROUP BY 1) SELECT count(*) n, " + ", ".join(f"round(avg(CASE WHEN hit BETWEEN 1 AND {k} THEN 1.0::DOUBLE ELSE 0 END), 6) recall_{k}" for k in (1, 5, 10, 20, 50)) + ", round(avg(CASE WHEN hit > 0 THEN 1.0::DOUBLE / hit ELSE 0 END), 6) mrr, round(avg(CASE WHEN hit BETWEEN 1 AND 50 THEN 1 / log2(hit + 1.0) ELSE 0 END), 6) ndcg_50, round(0.5 * avg(CASE WHEN hit BETWEEN 1 AND 50 THEN 1.0::DOUBLE ELSE 0 END) + 0.5 * avg(CASE WHEN hit > 0 THEN 1.0::DOUBLE / hit ELSE 0 END), 6) primary_score FROM h")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A4, A8, T9."""
    m = evaluate.retrieval(evaluate.first_hit(_relevant(spark, d, 100)))
    return m.select("n", *[r6(F.col(c)).alias(c) for c in m.columns if c != "n"])


@query(_REL + ", a AS (SELECT query_id, relevant, rank, sum(relevant::INT) OVER (PARTITION BY query_id ORDER BY rank)::DOUBLE / rank p FROM r WHERE rank <= 100), t AS (SELECT query_id, count(*) FILTER (relevant) total FROM r GROUP BY 1) SELECT query_id, round(CASE WHEN total > 0 THEN sum(CASE WHEN relevant THEN p ELSE 0 END) / least(total, 100) ELSE 0 END, 6) ap FROM a JOIN t USING (query_id) GROUP BY query_id, total")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    """A9, T10."""
    lib = library(spark, d)
    sizes = lib.groupBy("label").agg(F.count("*").alias("n"))
    total = asked(lib).join(sizes, "label").select("query_id", (F.col("n") - 1).alias("total"))
    return evaluate.average_precision(_relevant(spark, d, 100), total).select("query_id", r6(F.col("ap")).alias("ap"))


@query("WITH {S}, m AS (SELECT query_id, query_label, max(score) near FROM s GROUP BY 1, 2) SELECT query_label AS label, count(*) n, round(avg(near), 6) coverage FROM m GROUP BY ROLLUP (query_label)")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """A10, A5: nearest-neighbour similarity of the probes, overall and per label."""
    lib = library(spark, d)
    return top(lib, asked(lib), 1).rollup(F.col("query_label").alias("label")).agg(F.count("*").alias("n"), r6(F.avg("score")).alias("coverage"))


@query("WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s), v AS (SELECT query_id, query_label, label, count(*) n, min(rank) best FROM r WHERE rank <= 10 GROUP BY 1, 2, 3), w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, best) = 1) SELECT query_id, query_label AS truth, label AS predicted, n votes FROM w")
def knn_probe(spark: SparkSession, d: str) -> DataFrame:
    """Majority vote of ten neighbours, ties to the nearer label."""
    lib = library(spark, d)
    votes = top(lib, asked(lib), 10).groupBy("query_id", "query_label", "label").agg(F.count("*").alias("n"), F.min("rank").alias("best"))
    return rank.ranked(votes, F.desc("n"), "best").where("rank = 1").select("query_id", F.col("query_label").alias("truth"), F.col("label").alias("predicted"), F.col("n").alias("votes"))


@query("WITH c AS (SELECT label, count(*) n FROM embeddings GROUP BY 1) SELECT round(max(n)::DOUBLE / sum(n), 6) chance, count(*) labels FROM c")
def chance_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """A17."""
    c = read(spark, d, "embeddings").groupBy("label").count()
    return c.agg(r6(F.max("count") / F.sum("count")).alias("chance"), F.count("*").alias("labels"))


@query("WITH {E}, n AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v FROM e), t AS (SELECT label, i, sum(v[i]) x FROM n, generate_series(1, 64) t(i) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) s FROM t GROUP BY 1), z AS (SELECT label, count(*) k FROM n GROUP BY 1), g AS (SELECT n.id, n.label own, c.label, k, CASE WHEN n.label = c.label THEN (k - list_dot_product(v, s)) / greatest(k - 1, 1) ELSE 1 - list_dot_product(v, s) / k END gap FROM n, c JOIN z USING (label)), p AS (SELECT id, own, max(CASE WHEN own = label THEN gap END) a, min(CASE WHEN own <> label THEN gap END) b, max(CASE WHEN own = label THEN k END) k FROM g GROUP BY 1, 2) SELECT own AS label, count(*) n, round(avg(CASE WHEN k <= 1 OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) silhouette FROM p GROUP BY 1")
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    """Exact cosine silhouette from cluster sums."""
    s = evaluate.silhouette_cosine(library(spark, d).withColumn("v", V.unit(F.col("v"), 0.0)))
    return s.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("silhouette")).alias("silhouette"))


@query("WITH {E}" + _CENT + ", s AS (SELECT a.label, b.label other, row_number() OVER (PARTITION BY a.label ORDER BY round(list_cosine_similarity(a.m, b.m), 6) DESC, b.label) AS rank FROM c a, c b WHERE a.label <> b.label) SELECT label, round(count(*) FILTER (rank <= 3 AND (other = (label + 1) % 10 OR other = (label + 9) % 10)) / 2.0::DOUBLE, 6) agreement FROM s GROUP BY label")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    """The related labels among each label's nearest centroids."""
    c = rank.centroids(library(spark, d)).select(F.col("label").alias("id"), "label", "v")
    near = top(c, c.select(F.col("id").alias("query_id"), "label", "v"), 3)
    labels = c.select(F.col("label").alias("query_id"))
    related = labels.withColumn("id", F.explode(F.array((F.col("query_id") + 1) % 10, (F.col("query_id") + 9) % 10)))
    found = near.join(related, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n"))
    return labels.join(found, "query_id", "left").select(F.col("query_id").alias("label"), r6(F.coalesce("n", F.lit(0)) / F.lit(2.0)).alias("agreement"))


@query()
def size_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Nested shares of the library up to the whole, whitening fitted again per size, precision of fixed pairs of the least share."""
    lib, out = library(spark, d).where(F.col("id").isNotNull()).withColumn("part", F.crc32(F.col("id").cast("string")) % 8), None
    pairs = evaluate.fixed_pairs(lib.where(F.col("part") < 1))
    for share in (1, 2, 4, 8):
        own = F.col("part") < share
        white = linear.whitened(lib, 64, lib.where(own))
        sub = white.where(own)
        near = top(sub, asked(white), 1, digits=5).agg(r6(F.avg("score")).alias("coverage"), r6(F.avg((F.col("label") == F.col("query_label")).cast("double"))).alias("top1"))
        q = white.join(pairs, F.col("id") == F.col("query_id")).select("query_id", "label", "v")
        kept = evaluate.pair_precision(top(sub, q, 10, digits=5), pairs).select("n_pairs", r6(F.col("precision")).alias("pair_precision"))
        t = sub.agg(F.count("*").alias("size")).crossJoin(near).crossJoin(kept)  # one row each
        out = t if out is None else out.unionByName(t)
    return out


_TAGS = "w AS (SELECT p_partkey id, p_brand artist, unnest(list_distinct(string_split(p_name, ' ') || [p_type])) tag FROM part), z AS (SELECT id, artist, count(*) n FROM w GROUP BY 1, 2), p AS (SELECT a.id query_id, b.id, count(*) shared FROM w a JOIN w b USING (tag) WHERE a.id % 100 = 0 AND a.id <> b.id AND a.artist <> b.artist GROUP BY 1, 2), j AS (SELECT query_id, p.id, shared::DOUBLE / (x.n + y.n - shared) jac FROM p JOIN z x ON x.id = query_id JOIN z y ON y.id = p.id WHERE shared >= 2)"


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("artist"), F.array_distinct(F.concat(F.split("p_name", " "), F.array("p_type"))).alias("tags"))


def _wide(df: DataFrame) -> int:
    """Parts of a shuffle, told as a number: adaptive plans go by bytes and would leave few tasks, of which each makes many pairs."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _tag_classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, artist, tags), queries (query_id, qa, qtags) and the similar sets (qtags, tags, jac) of two shared tags or more, each set once."""
    rows = _tags(spark, d)
    rows = written(rows.repartition("id").withColumn("tags", F.array_sort("tags")), "tags")
    q = rows.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), F.col("artist").alias("qa"), F.col("tags").alias("qtags"))
    flat = rows.select("tags").distinct().withColumn("tag", F.explode("tags"))
    shared = q.select("qtags").distinct().withColumn("tag", F.explode("qtags")).join(flat, "tag").groupBy("qtags", "tags").agg(F.count("*").alias("shared"))
    jac = F.col("shared") / (F.size("qtags") + F.size("tags") - F.col("shared"))
    return rows, q, written(shared.where(F.col("shared") >= 2).select("qtags", "tags", jac.alias("jac")), "tag-sets")


def _parts(rows: DataFrame) -> DataFrame:
    """(tags, _parts): the sets of more than CHUNK rows (a CHUNK-th of the rows at most) and in how many parts they are dealt."""
    many = rows.groupBy("tags").agg(F.count("*").alias("_n")).where(F.col("_n") > CHUNK)
    return F.broadcast(many.select("tags", F.ceil(F.col("_n") / CHUNK).cast("int").alias("_parts")))


def _dealt(rows: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and similar sets with a number _part: about CHUNK rows of one set have the same, near has each set with all of its own."""
    parts, n = _parts(rows), F.coalesce("_parts", F.lit(1))
    dealt = rows.join(parts, "tags", "left").withColumn("_part", F.pmod(F.xxhash64("id"), n).cast("int")).drop("_parts").repartition(_wide(rows), "tags", "_part")
    return dealt, near.join(parts, "tags", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts")


def _jaccard(rows: DataFrame, q: DataFrame, near: DataFrame, *carry: str) -> DataFrame:
    """Stated queries against all rows through the tags they share; sets are compared once, and a query meets the ids of a set and artist as one list."""
    dealt, near = _dealt(rows, near)
    lists = dealt.groupBy("tags", "_part", "artist").agg(F.collect_list("id").alias("_ids"))
    asked = near.join(q, "qtags").select("tags", "_part", "query_id", "qa", "jac", *carry)
    return lists.hint("merge").join(asked, ["tags", "_part"]).where(F.col("artist") != F.col("qa")).select("query_id", F.explode("_ids").alias("id"), "jac", *carry).where(F.col("id") != F.col("query_id"))


def _heads(df: DataFrame, by: str, k: int, *order) -> DataFrame:
    """The rows of each set that can be among the first k once those of any one artist are left out.

    More than k rows of an artist are never among k; and of the 2 k first of the others any artist has k at most.
    """
    few = rank.capped(df, "artist", k, *order, by=by)
    return rank.ranked(few, *order, by=by, name="_n").where(F.col("_n") <= 2 * k).drop("_n")


def graded_heads(rows: DataFrame, q: DataFrame, near: DataFrame, k: int, *, by_id: bool) -> DataFrame:
    """(query_id, id, jac): of each query's similar rows the k best ones (ties: smaller id), with by_id also the k smallest ids, and a few more."""
    heads = near.join(_heads(rows.where(F.col("id").isNotNull() & F.col("artist").isNotNull()), "tags", k, "id"), "tags").select("qtags", "id", "artist", "jac")
    best = _heads(heads, "qtags", k, F.desc("jac"), "id")
    kept = best.unionByName(_heads(heads, "qtags", k, "id")).distinct() if by_id else best
    return q.join(kept, "qtags").where((F.col("id") != F.col("query_id")) & (F.col("artist") != F.col("qa"))).select("query_id", "id", "jac")


@query("WITH " + _TAGS + " SELECT query_id, id, round(jac, 6) jaccard FROM j WHERE jac >= 0.5")
def tag_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """J11, F8."""
    rows, q, near = _tag_classes(spark, d)
    return _jaccard(rows, q, near.where(F.col("jac") >= 0.5).withColumn("jac", r6(F.col("jac")))).select("query_id", "id", F.col("jac").alias("jaccard"))


@query("WITH " + _TAGS + ", r AS (SELECT query_id, jac grade, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY jac DESC, id) ideal FROM j) SELECT query_id, round(sum(CASE WHEN rank <= 10 THEN grade / log2(rank + 1.0) ELSE 0 END) / sum(CASE WHEN ideal <= 10 THEN grade / log2(ideal + 1.0) ELSE 0 END), 6) ndcg FROM r GROUP BY 1")
def graded_ndcg(spark: SparkSession, d: str) -> DataFrame:
    """The order by id, graded by tag similarity."""
    r = rank.ranked(graded_heads(*_tag_classes(spark, d), 10, by_id=True), "id").withColumnRenamed("jac", "grade")
    return evaluate.graded(r, 10).select("query_id", r6(F.col("ndcg")).alias("ndcg"))


_WIN = "w AS (SELECT id, i, v[i * 8 + 1 : i * 8 + 8] x FROM e, generate_series(0, 7) t(i))"


def _windows(lib: DataFrame) -> DataFrame:
    return lib.select("id", "v", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("v"), i * 8 + 1, F.lit(8)))).alias("i", "x")).withColumn("i", F.col("i").cast("long"))


@query("WITH {S}, p AS (SELECT query_id, id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20), " + _WIN + ", g AS (SELECT query_id, p.id, a.i, b.i j, list_dot_product(a.x, b.x) sim FROM p JOIN w a ON a.id = query_id JOIN w b ON b.id = p.id), l AS (SELECT query_id, id, avg(m) x FROM (SELECT query_id, id, i, max(sim) m FROM g GROUP BY ALL) GROUP BY ALL), r AS (SELECT query_id, id, avg(m) y FROM (SELECT query_id, id, j, max(sim) m FROM g GROUP BY ALL) GROUP BY ALL) SELECT query_id, id, round((x + y) / 2, 6) maxsim FROM l JOIN r USING (query_id, id)")
def maxsim_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Late interaction on each query's pool of 20."""
    lib = library(spark, d)
    parts = lib.select("id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("v"), i * 8 + 1, F.lit(8))).alias("w"))
    pool = top(lib, asked(lib), 20).select("query_id", "id").join(parts, "id").join(parts.select(F.col("id").alias("query_id"), F.col("w").alias("qw")), "query_id")
    return pool.select("query_id", "id", r6(late.maxsim(F.col("qw"), F.col("w"))).alias("maxsim"))


@query("WITH {E}, " + _WIN + " SELECT a.id, a.i, round(max(list_dot_product(a.x, b.x)), 6) score FROM w a JOIN w b ON a.id = b.id AND abs(a.i - b.i) >= 2 GROUP BY 1, 2")
def repeated_sections(spark: SparkSession, d: str) -> DataFrame:
    """V26's scores: windows of one set against each other."""
    s = late.repeated_scores(_windows(library(spark, d)), "id", "i", "x", 2)
    return s.select("id", "i", r6(F.col("score")).alias("score"))


@query("WITH {E}, " + _WIN + ", m AS (SELECT id, k, avg(x[k]) y FROM w, generate_series(1, 8) t(k) GROUP BY 1, 2), g AS (SELECT id, list(y ORDER BY k) g FROM m GROUP BY 1), c AS (SELECT id, i, 1 - list_dot_product(x, g) f, 1 - list_dot_product(x, lag(x) OVER k) a, 1 - list_dot_product(x, lead(x) OVER k) b FROM w JOIN g USING (id) WINDOW k AS (PARTITION BY id ORDER BY i)) SELECT id, i, round(f + 0.5 * greatest(coalesce(a, 0), coalesce(b, 0)), 6) score FROM c")
def salient_sections(spark: SparkSession, d: str) -> DataFrame:
    """V27's scores."""
    w = _windows(library(spark, d)).select("id", "i", "x")
    g = V.mean_vector("x", "id")(w.select("id", "x")).withColumnRenamed("x", "g")
    return late.salient_scores(w.join(g, "id"), "id", "i", "x", "g").select("id", "i", r6(F.col("score")).alias("score"))


#: Greedy windows as a recursion over lists: the best one two apart from all chosen, else the best that is left.
_STEPS = ", o AS (SELECT id, list(i ORDER BY score DESC, i) o FROM sc GROUP BY id), r AS (SELECT id, o, []::BIGINT[] c FROM o UNION ALL SELECT id, o, list_append(c, coalesce(list_filter(o, lambda x: list_bool_and(list_transform(c || [x - 1000], lambda y: abs(x - y) >= 2)))[1], list_filter(o, lambda x: NOT list_contains(c, x))[1])) FROM r WHERE len(c) < least(3, len(o))) SELECT id, c[k] AS i, k AS rank FROM r, generate_series(1, 3) t(k) WHERE len(c) = least(3, len(o)) AND k <= len(c)"


@query("WITH RECURSIVE {E}, " + _WIN + ", sc AS (SELECT a.id, a.i, round(max(list_dot_product(a.x, b.x)), 9) score FROM w a JOIN w b ON a.id = b.id AND abs(a.i - b.i) >= 2 GROUP BY 1, 2)" + _STEPS)
def diverse_sections(spark: SparkSession, d: str) -> DataFrame:
    """The three windows that repeat most, two apart; the SQL recurses over lists."""
    scored = late.repeated_scores(_windows(library(spark, d)), "id", "i", "x", 2)
    return late.diverse_top(scored.withColumn("score", F.round("score", 9)), "id", "i", 3, 2)


@query("WITH {E}, " + _WIN + ", c AS (SELECT id, i, x, i * 4 + 4.0::DOUBLE mid FROM w), h AS (SELECT id, x, coalesce((lead(mid) OVER k + mid) / 2, i * 4 + 8) - coalesce((lag(mid) OVER k + mid) / 2, i * 4) wt FROM c WINDOW k AS (PARTITION BY id ORDER BY i)) SELECT id, k - 1 AS pos, round(sum(wt * x[k]) / sum(wt), 6) x FROM h, generate_series(1, 8) t(k) GROUP BY 1, 2")
def pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Windows of width 8 with a hop of 4."""
    w = _windows(library(spark, d)).select("id", (F.col("i") * 4).alias("start"), "x")
    p = late.pooled(w, "id", "start", 8, "x")
    return p.select("id", F.posexplode("x").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), r6(F.col("x")).alias("x"))


@query("SELECT doc_id, unnest(CASE WHEN n_chars <= 1000 THEN [0::BIGINT] ELSE list_sort(list_distinct(generate_series(0::BIGINT, greatest(n_chars - 1000, 0), 400) || [n_chars - 1000])) END) AS start FROM documents WHERE n_chars > 0")
def windows_tail(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 1000 every 400, the last aligned to the end."""
    return read(spark, d, "documents").where(F.col("n_chars") > 0).select("doc_id", F.explode(late.window_starts(F.col("n_chars"), 1000, 400)).alias("start"))


_SAFE = [p for p in text.JUNK_TITLE if "(?!" not in p]


@query("SELECT doc_id, coalesce(regexp_matches(lower(text), '(?i)" + "|".join([*_SAFE, r"\bthe\b.*\bof\b"]).replace("'", "''") + "'), false) AS junk FROM documents")
def junk_filter(spark: SparkSession, d: str) -> DataFrame:
    """PF7, UD3 on whole texts, which have no artist, with one more pattern; the SQL lacks the pattern with a look-ahead."""
    return read(spark, d, "documents").select("doc_id", text.is_junk(F.lower("text"), F.lit(None).cast("string"), (r"\bthe\b.*\bof\b",)).alias("junk"))


@query("WITH k AS (SELECT p_partkey id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || '|' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS key FROM part) SELECT key, min(id) id, count(*) n FROM k GROUP BY key")
def catalogue_dedup(spark: SparkSession, d: str) -> DataFrame:
    """U8, A3: first row of each normalised title and artist."""
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.catalogue_key(F.col("p_name"), F.col("p_brand")).alias("key")).groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query("WITH c AS (SELECT p_partkey AS row, lower(p_name) title, lower(p_brand) artist FROM part), k AS (SELECT *, CASE WHEN title = 'ring' THEN 0 WHEN starts_with(title, 'ring') THEN 1 WHEN contains(title, 'ring') THEN 2 WHEN contains(title || ' ' || artist, 'ring') THEN 3 END AS class FROM c) SELECT class::BIGINT AS class, row, title, artist FROM (SELECT * FROM k WHERE class IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title, artist ORDER BY class, length(title), row) = 1) ORDER BY class, length(title), row LIMIT 25")
def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    """T7."""
    c = read(spark, d, "part").select(F.col("p_partkey").alias("row"), F.lower("p_name").alias("title"), F.lower("p_brand").alias("artist"))
    return resolve.search(c, "ring", 25).select("class", "row", "title", "artist")


@query("WITH c AS (SELECT p_partkey AS row, lower(p_name) title, lower(p_brand) artist FROM part), k AS (SELECT *, CASE WHEN title = 'ring 2' THEN 0 WHEN starts_with(title, 'ring 2') THEN 1 WHEN contains(title, 'ring 2') THEN 2 WHEN contains(title || ' ' || artist, 'ring 2') THEN 3 WHEN contains(title || ' ' || artist, 'ring') AND contains(title || ' ' || artist, '2') THEN 4 END AS class FROM c) SELECT class::BIGINT AS class, row, title, artist FROM (SELECT * FROM k WHERE class IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title, artist ORDER BY class, length(title), row) = 1) ORDER BY class, length(title), row LIMIT 60")
def search_words(spark: SparkSession, d: str) -> DataFrame:
    """T7, the class of all words in any order."""
    c = read(spark, d, "part").select(F.col("p_partkey").alias("row"), F.lower("p_name").alias("title"), F.lower("p_brand").alias("artist"))
    return resolve.search(c, "ring 2", 60).select("class", "row", "title", "artist")


_SEEDS = [(0, "small ring", "brand#2"), (1, "red widget", None), (2, "ring", None), (3, "no such thing", None), (4, "small ring", "nobody")]


@query("WITH c AS (SELECT p_partkey AS row, lower(p_name) title, lower(p_brand) artist FROM part), s(ord, t, a) AS (VALUES (0::BIGINT, 'small ring', 'brand#2'), (1, 'red widget', NULL), (2, 'ring', NULL), (3, 'no such thing', NULL), (4, 'small ring', 'nobody')), m AS (SELECT ord, row, CASE WHEN t = title AND a = artist THEN 0 WHEN t = title THEN 1 ELSE 2 END stage, length(title) n FROM s JOIN c ON contains(title, t)), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY ord ORDER BY stage, n, row) = 1) SELECT s.ord, b.row, coalesce(stage, 3)::BIGINT stage FROM s LEFT JOIN b USING (ord)")
def resolve_seeds(spark: SparkSession, d: str) -> DataFrame:
    """J1-J4."""
    c = read(spark, d, "part").select(F.col("p_partkey").alias("row"), F.lower("p_name").alias("title"), F.lower("p_brand").alias("artist"))
    return resolve.resolve(spark.createDataFrame(_SEEDS, "ord long, title string, artist string"), c)


@query("WITH l AS (SELECT l_orderkey o, l_partkey p, l_discount m FROM lineitem), s AS (SELECT b.p, sum(a.m) score, count(*) hits FROM l a JOIN l b ON a.o = b.o AND a.p <> b.p WHERE a.p % 100 = 0 AND b.p % 100 <> 0 GROUP BY 1) SELECT row_number() OVER (ORDER BY round(score, 6) DESC, hits DESC, p) AS rank, p AS part, round(score, 6) score, hits FROM s QUALIFY rank <= 25")
def similar_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """A2: parts bought together with the seeds; sums of matches, numbers of hits, seeds left out."""
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_discount").alias("m"))  # noqa: E741
    seeds = l.where(F.col("p") % 100 == 0).select("o", F.col("p").alias("sp"), F.col("m").alias("sm"))
    s = seeds.join(l.where(F.col("p") % 100 != 0), "o").groupBy("p").agg(r6(F.sum("sm")).alias("score"), F.count("*").alias("hits"))
    best = s.orderBy(F.desc("score"), F.desc("hits"), "p").limit(25)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), F.desc("hits"), "p")).cast("long").alias("rank"), F.col("p").alias("part"), "score", "hits")


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("user_id").alias("session"), F.concat_ws("-", "event_type", (F.col("event_id") % 50).cast("string")).alias("key"), F.round("value").cast("long").alias("value"), "ts")
    return e.withColumn("digest", F.md5(F.concat_ws("/", F.col("session").cast("string"), "key", F.col("value").cast("string"))))


@query("WITH {EV}, o AS (SELECT DISTINCT session, key, val FROM ev) SELECT session, key, CASE WHEN count(*) = 1 THEN min(val) END AS value, count(*) n FROM o GROUP BY 1, 2")
def session_merge(spark: SparkSession, d: str) -> DataFrame:
    """A27, F11, SK8."""
    return ratings.merge_sessions(_snapshots(spark, d))


@query("WITH {EV} SELECT session, key, count(DISTINCT val) n FROM ev GROUP BY 1, 2 HAVING count(DISTINCT val) > 1")
def session_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return ratings.conflicts(_snapshots(spark, d))


_EDGES = "e AS (SELECT DISTINCT o_custkey c, -1 - l_suppkey s FROM orders JOIN lineitem ON l_orderkey = o_orderkey), g AS (SELECT c AS a, s AS b FROM e UNION ALL SELECT s, c FROM e)"


@query("WITH " + _EDGES + ", h0 AS (SELECT DISTINCT a node FROM g WHERE a % 100 = 0 AND a >= 0), h1 AS (SELECT DISTINCT b node FROM g JOIN h0 ON g.a = h0.node), h2 AS (SELECT DISTINCT b node FROM g JOIN h1 ON g.a = h1.node), z AS (SELECT node, 0 hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) SELECT node, min(hop)::BIGINT hop FROM z GROUP BY 1")
def bfs_two_hop(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers (negative numbers) as a two-sided graph."""
    g = _graph(spark, d)
    return graph.hops(g, g.where((F.col("src") >= 0) & (F.col("src") % 100 == 0)).select(F.col("src").alias("node")))


def _graph(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")  # noqa: E741
    return graph.both_ways(o.join(l, "o_orderkey").select(F.col("o_custkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst")))


@query("WITH RECURSIVE " + _EDGES + ", cc(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM g UNION SELECT u.node, min(v.component) FROM recurring.cc u JOIN g ON g.a = u.node JOIN recurring.cc v ON v.node = g.b WHERE v.component < u.component GROUP BY u.node) SELECT node, component FROM cc")
def components(spark: SparkSession, d: str) -> DataFrame:
    """A29."""
    return graph.components(_graph(spark, d)).select("node", "component")


@query("WITH c AS (SELECT DISTINCT o_custkey c, o_orderpriority p FROM orders), s AS (SELECT c FROM c WHERE p LIKE '1%' INTERSECT SELECT c FROM c WHERE p LIKE '5%'), x AS (SELECT c FROM c WHERE p LIKE '1%' EXCEPT SELECT c FROM c WHERE p LIKE '5%') SELECT 'both' AS state, count(*) n FROM s UNION ALL SELECT 'first only', count(*) FROM x")
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Set operations of two splits."""
    o = read(spark, d, "orders")
    one, five = (o.where(F.startswith("o_orderpriority", F.lit(k))).select("o_custkey").distinct() for k in "15")
    return one.intersect(five).agg(F.lit("both").alias("state"), F.count("*").alias("n")).unionByName(one.subtract(five).agg(F.lit("first only").alias("state"), F.count("*").alias("n")))


@query("WITH k AS (SELECT vec_id id, label::BIGINT label, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 7919) % 10007, vec_id) k, count(*) OVER (PARTITION BY label) n FROM embeddings) SELECT id, label, CASE WHEN k <= floor(n * 0.8) THEN 'train' ELSE 'test' END split FROM k")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """A30."""
    return sampling.stratified_split(library(spark, d).select("id", "label"), "label", "id", 0.8, (F.col("id") * 7919) % 10007)


@query("WITH c AS (SELECT label::BIGINT label, count(*) n FROM embeddings GROUP BY ALL), s AS (SELECT label, n, (row_number() OVER (ORDER BY label) - 1) // 4 batch FROM c), t AS (SELECT batch, label, n, unnest(range(64)) slot FROM s), r AS (SELECT label::BIGINT label, vec_id id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 i FROM embeddings) SELECT batch, t.label, slot, id FROM t JOIN r ON r.label = t.label AND r.i = slot % n")
def pk_batches(spark: SparkSession, d: str) -> DataFrame:
    """Four labels with 64 slots, short labels repeat."""
    return sampling.pk_batches(library(spark, d).select("id", "label"), "label", "id", 4, 64)


@query("WITH c AS (SELECT label::BIGINT label, vec_id % 5 fold, avg(embedding[1]::DOUBLE) m, sum(embedding[1]::DOUBLE) s, count(*) n FROM embeddings GROUP BY 1, 2) SELECT label, round(avg(m), 6) fold_macro, round(sum(s) / sum(n), 6) weighted, count(*) folds FROM c GROUP BY 1")
def fold_macro_vs_weighted(spark: SparkSession, d: str) -> DataFrame:
    """A23."""
    x = library(spark, d).select("label", (F.col("id") % 5).alias("fold"), F.get("v", F.lit(0)).alias("x"))
    return evaluate.macro_and_weighted(x, "fold", "label", "x").select("label", r6(F.col("fold_macro")).alias("fold_macro"), r6(F.col("weighted")).alias("weighted"), "folds")


@query("WITH v AS (SELECT row_number() OVER (ORDER BY vec_id % 1024, vec_id) - 1 k, embedding[1]::DOUBLE x FROM embeddings), n AS (SELECT count(*) n FROM v), p AS (SELECT draw, ('0x' || substr(md5(draw || ':' || i), 1, 8))::BIGINT % n k FROM n, generate_series(0, 99) a(draw), generate_series(0, n - 1) b(i)), m AS (SELECT draw, avg(x) m FROM p JOIN v USING (k) GROUP BY 1) SELECT round(quantile_cont(m, 0.025), 6) low, round(quantile_cont(m, 0.975), 6) high, round(avg(CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) positive FROM m")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """A21."""
    b = evaluate.bootstrap(library(spark, d).select("id", F.get("v", F.lit(0)).alias("x")), "x", 100, "id")
    return b.agg(r6(F.percentile("mean", 0.025)).alias("low"), r6(F.percentile("mean", 0.975)).alias("high"), r6(F.avg((F.col("mean") > 0).cast("double"))).alias("positive"))


@query("SELECT event_type, count(*) n, round(avg(value), 6) mean, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """A26."""
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.percentile("value", 0.5)).alias("p50"), r6(F.percentile("value", 0.95)).alias("p95"))


@query("SELECT coalesce(o_orderkey, l_orderkey) AS key, CASE WHEN o_orderkey IS NULL THEN 'extra' ELSE 'missing' END AS state FROM (SELECT DISTINCT o_orderkey FROM orders) FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL OR l_orderkey IS NULL")
def full_outer_audit(spark: SparkSession, d: str) -> DataFrame:
    """J14, SC18."""
    return ingest.missing_and_extra(read(spark, d, "orders").select(F.col("o_orderkey").alias("key")), read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@query("SELECT n_name AS nation, o_orderpriority AS priority, count(*) n, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def denormalized(spark: SparkSession, d: str) -> DataFrame:
    """Chain of joins, only the columns it needs."""
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))  # noqa: E741
    j = l.join(read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderpriority"), "o_orderkey").join(read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey").join(read(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return j.groupBy(F.col("n_name").alias("nation"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.sum("r"), 2).alias("revenue"))


@query("WITH {FEAT}, z AS (SELECT id, a, (b - avg(b) OVER ()) / (stddev_pop(b) OVER () + 1e-9) z FROM f) SELECT id, CASE WHEN a > 30 THEN 'punchy' WHEN a > 20 THEN 'dynamic' ELSE 'smooth' END || ', ' || CASE WHEN z > 0.5 THEN 'bright' WHEN z < -0.5 THEN 'dark' ELSE 'balanced' END vibe FROM z")
def vibe_buckets(spark: SparkSession, d: str) -> DataFrame:
    """PF15, PF16: absolute and relative buckets."""
    f = features(spark, d)
    m = f.agg(F.avg("b").alias("m"), F.stddev_pop("b").alias("s"))
    z = (F.col("b") - F.col("m")) / (F.col("s") + 1e-9)
    one = F.when(F.col("a") > 30, "punchy").when(F.col("a") > 20, "dynamic").otherwise("smooth")
    two = F.when(z > 0.5, "bright").when(z < -0.5, "dark").otherwise("balanced")
    return f.join(F.broadcast(m)).select("id", F.concat_ws(", ", one, two).alias("vibe"))


@query("WITH a AS (SELECT l_returnflag scene, avg(l_discount) x FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_returnflag scene, avg(l_discount) y FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) SELECT scene, round((y - x) / x, 6) delta, y >= x * 0.9 AS holds FROM a JOIN b USING (scene)")
def report_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Relative change per scene and the -10 % guard."""
    l = read(spark, d, "lineitem")  # noqa: E741
    a, b = (l.where(F.col("l_linestatus") == s).groupBy(F.col("l_returnflag").alias("scene")).agg(F.avg("l_discount").alias(n)) for s, n in (("F", "x"), ("O", "y")))
    return a.join(b, "scene").select("scene", r6((F.col("y") - F.col("x")) / F.col("x")).alias("delta"), (F.col("y") >= F.col("x") * 0.9).alias("holds"))


@query("SELECT event_id, event_type, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 50")
def genre_quota(spark: SparkSession, d: str) -> DataFrame:
    """TR3, T11."""
    e = read(spark, d, "events").select("event_id", "event_type", "user_id", "value")
    return sampling.quota(e, "event_type", 50, F.desc("value"), "event_id").drop("value")


@query("SELECT user_id, count(*) FILTER (gap < 0) backwards, round(max(gap), 6) longest FROM (SELECT user_id, epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY event_id)) gap FROM events) GROUP BY 1")
def monotonic_check(spark: SparkSession, d: str) -> DataFrame:
    """Differences of neighbours."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (at - F.lag(at).over(w)) / 1e6
    return read(spark, d, "events").select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.count_if(F.col("gap") < 0).alias("backwards"), r6(F.max("gap")).alias("longest"))


@query("SELECT s_nationkey::BIGINT nation, floor(max(s_acctbal))::BIGINT most, floor(min(s_acctbal))::BIGINT least, floor(avg(s_acctbal))::BIGINT mean, arg_max(s_suppkey, s_acctbal) best FROM supplier GROUP BY 1")
def column_summary(spark: SparkSession, d: str) -> DataFrame:
    """SC34: floored extremes and mean, row of the largest value."""
    b = F.col("s_acctbal")
    return read(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("nation")).agg(F.floor(F.max(b)).alias("most"), F.floor(F.min(b)).alias("least"), F.floor(F.avg(b)).alias("mean"), F.max_by("s_suppkey", F.struct(b, -F.col("s_suppkey"))).alias("best"))


@query("WITH {E} SELECT id, round(list_dot_product(v, v), 6) norm2, round(v[1] / (sqrt(list_dot_product(v, v)) + 1e-9), 6) first, round(list_max(v), 6) AS most, len(v) n FROM e")
def vector_functions(spark: SparkSession, d: str) -> DataFrame:
    """V5, F9, F10."""
    v = F.col("v")
    return library(spark, d).select("id", r6(V.dot(v, v)).alias("norm2"), r6(F.get(V.unit(v), F.lit(0))).alias("first"), r6(F.array_max(v)).alias("most"), F.size(v).cast("long").alias("n"))


@query("WITH n AS (SELECT event_id // 100 k, event_id, value FROM events), b AS (SELECT k, list(value ORDER BY event_id) v FROM n GROUP BY 1) SELECT k, i AS pos, round(v[(round_even(i * (len(v) - 1) / 7.0, 0) + 1)::BIGINT], 6) x FROM b, generate_series(0, 7) t(i)")
def budget_freeze(spark: SparkSession, d: str) -> DataFrame:
    """Eight entries at half-even rounded places."""
    b = read(spark, d, "events").groupBy(F.floor(F.col("event_id") / 100).alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"]).alias("v"))
    return b.select("k", F.posexplode(late.budget(F.col("v"), 8)).alias("pos", "x")).select("k", F.col("pos").cast("long").alias("pos"), r6(F.col("x")).alias("x"))


@query("WITH {S}, r AS (SELECT *, label IN ((query_label + 1) % 10, (query_label + 9) % 10) rel FROM s) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score * CASE WHEN rel THEN 1.2 ELSE 1 END, 6) DESC, id) AS rank, id, round(score * CASE WHEN rel THEN 1.2 ELSE 1 END, 6) score FROM r QUALIFY rank <= 10")
def related_boost(spark: SparkSession, d: str) -> DataFrame:
    """Related labels' scores are multiplied, negative ones too, inside the pass."""
    lib = library(spark, d)

    def boost(score, ids, label, label_q):
        gap = (label[:, None] - label_q[None, :]) % 10
        return score * np.where((gap == 1) | (gap == 9), 1.2, 1.0)

    return top(lib, asked(lib), 10, adjust=boost).select("query_id", "rank", "id", "score")


@query("SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key FROM documents")
def squeeze_key(spark: SparkSession, d: str) -> DataFrame:
    """F1 on whole texts."""
    return read(spark, d, "documents").select("doc_id", text.squeeze(F.col("text")).alias("key"))


@query("WITH s AS (SELECT l_returnflag f, l_linestatus t, l_quantity q FROM lineitem) SELECT f AS flag, t AS status, count(*) n, sum(q) quantity FROM s GROUP BY GROUPING SETS ((f, t), (f), ())")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Several groupings in one pass."""
    l = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity")  # noqa: E741
    return l.rollup("flag", "status").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


from . import files, reports, songs  # noqa: E402, F401  they register their queries
