"""Registered queries over titles and artists: look-ups, text predicates, readers (J1-J8, J13, PF, F, SC).

Parts stand in for songs: some titles get a version suffix or a guest, some artists a second one.  Every row whose number
is divisible by 40 asks for a song: by its title and artist, by the title alone, by a part of it, or for what is not there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import resolve
from ..sources import ingest
from ..sources.storage import scratch, written
from .catalogue import query, read

LIB = """lib AS (SELECT p_partkey AS "row", p_type scene, p_size size, p_name || CASE WHEN p_partkey % 11 = 3 THEN ' (Karaoke Version)' WHEN p_partkey % 13 = 5 THEN ' - Sped Up' WHEN p_partkey % 7 = 2 THEN ' feat. ' || p_type WHEN p_partkey % 17 = 4 THEN ' (Remastered 2011)' ELSE '' END title, p_brand || CASE WHEN p_partkey % 5 = 1 THEN ' & Brand#1' WHEN p_partkey % 5 = 2 THEN ', Guest' WHEN p_partkey % 5 = 3 THEN ' ft. Guest' ELSE '' END artist FROM part)"""


def songs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    tail = F.when(k % 11 == 3, " (Karaoke Version)").when(k % 13 == 5, " - Sped Up").when(k % 7 == 2, F.concat(F.lit(" feat. "), "p_type")).when(k % 17 == 4, " (Remastered 2011)").otherwise("")
    more = F.when(k % 5 == 1, " & Brand#1").when(k % 5 == 2, ", Guest").when(k % 5 == 3, " ft. Guest").otherwise("")
    return read(spark, d, "part").select(k.alias("row"), F.col("p_type").alias("scene"), F.col("p_size").alias("size"), F.concat("p_name", tail).alias("title"), F.concat("p_brand", more).alias("artist"))


_MATCH = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[(\[][^)\]]*[)\]]', ' ', 'g'), '\s+-\s.*', '', 'g'), '(.) (?:featuring|feat\.|feat|ft\.|ft) .*', '\1'), '\s+', ' ', 'g'))"
_PRIMARY = "trim(split_part(split_part(lower(artist), ',', 1), ' & ', 1))"
KEYS = LIB + ', keys AS (SELECT "row", title, artist, scene, ' + _MATCH.format("lower(title)") + f" title_key, {_PRIMARY} artist_key, lower(artist) full_artist, regexp_matches(lower(title), '\\b(?:karaoke|tribute|slowed|reverb|nightcore|instrumental|remix|cover|live|acoustic)\\b')::INT derivative FROM lib)"
SEEDS = KEYS + """, seeds AS (SELECT "row" ord, CASE "row" // 40 % 6 WHEN 2 THEN split_part(title_key, ' ', 1) WHEN 4 THEN 'no such ' || "row" ELSE title_key END t, CASE "row" // 40 % 6 WHEN 1 THEN NULL WHEN 3 THEN 'nobody' WHEN 5 THEN 'brand' ELSE full_artist END a, CASE "row" // 40 % 6 WHEN 1 THEN '' WHEN 3 THEN 'nobody' WHEN 5 THEN 'brand' ELSE artist_key END p FROM keys WHERE "row" % 40 = 0)"""


def _with_keys(s: DataFrame) -> DataFrame:
    title, artist = text.ascii_fold("title"), text.ascii_fold("artist")
    return s.withColumn("title_key", text.match_key(title)).withColumn("artist_key", text.before_separators(artist)).withColumn("full_artist", artist)


def keyed(spark: SparkSession, d: str) -> DataFrame:
    return _with_keys(songs(spark, d))


def keyed_classes(spark: SparkSession, d: str) -> DataFrame:
    """Keys of each title and artist, made once, with the first of their rows."""
    return _with_keys(songs(spark, d).groupBy("title", "artist").agg(F.min("row").alias("row")))


def seeds(k: DataFrame) -> DataFrame:
    kind = F.floor(F.col("row") / 40) % 6
    pick = lambda c, none: F.when(kind == 1, none).when(kind == 3, "nobody").when(kind == 5, "brand").otherwise(F.col(c))
    t = F.when(kind == 2, F.substring_index("title_key", " ", 1)).when(kind == 4, F.concat(F.lit("no such "), F.col("row").cast("string"))).otherwise(F.col("title_key"))
    return k.where(F.col("row") % 40 == 0).select(F.col("row").alias("ord"), t.alias("t"), pick("full_artist", F.lit(None)).alias("a"), pick("artist_key", F.lit("")).alias("p"))


_FIND = """, m AS (SELECT ord, k."row", t = title_key exact, coalesce(length(a) > 0 AND (contains(artist_key, a) OR contains(full_artist, a)), false) own FROM seeds JOIN keys k ON contains(title_key, t)), e AS (SELECT *, bool_or(exact) OVER (PARTITION BY ord) hit FROM m), f AS (SELECT ord, "row" FROM e WHERE exact OR NOT hit QUALIFY row_number() OVER (PARTITION BY ord ORDER BY own DESC, "row") = 1)"""


@query("WITH " + SEEDS + _FIND + ' SELECT ord, "row" FROM f')
def song_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Title key or part of it, narrowed to the artist where that leaves any row."""
    k = keyed(spark, d)
    return resolve.find_songs(seeds(k), k)


@query("WITH " + SEEDS + _FIND + ', g AS (SELECT min(ord) ord, "row" FROM f GROUP BY "row") SELECT ord, "row", NULL::VARCHAR unmatched FROM g UNION ALL SELECT ord, NULL, t FROM seeds WHERE ord NOT IN (SELECT ord FROM f)')
def profile_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of many seeds, once each, and the seeds without any."""
    asked = written(seeds(keyed(spark, d)), "seeds")
    found, left = resolve.resolve_profile(asked, keyed_classes(spark, d))
    return found.select("ord", "row", F.lit(None).cast("string").alias("unmatched")).unionByName(left.select("ord", F.lit(None).cast("long").alias("row"), F.col("t").alias("unmatched")))


@query("WITH " + KEYS + ' SELECT title_key, artist_key, "row" FROM keys QUALIFY row_number() OVER (PARTITION BY title_key, artist_key ORDER BY derivative, length(title), "row") = 1')
def pair_index(spark: SparkSession, d: str) -> DataFrame:
    """J3, PF12."""
    return resolve.pair_index(keyed(spark, d))


@query("WITH " + SEEDS + """, c AS (SELECT ord, k."row", CASE WHEN p <> '' AND t = title_key AND p = artist_key THEN 0 WHEN coalesce(a, '') = '' AND t = title_key THEN 1 WHEN coalesce(a, '') = '' OR contains(full_artist, a) THEN CASE WHEN t = title_key THEN 2 ELSE 3 END END stage, derivative, length(title) n FROM seeds JOIN keys k ON contains(title_key, t)), b AS (SELECT ord, "row", stage FROM c WHERE stage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ord ORDER BY stage, CASE WHEN stage < 2 THEN derivative END, CASE WHEN stage < 2 THEN n END, "row") = 1) SELECT ord, b."row", coalesce(stage, 4)::BIGINT stage FROM seeds LEFT JOIN b USING (ord)""")
def row_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Pair, title alone, first of the title, first that holds it."""
    k = keyed(spark, d)
    return resolve.find_row(seeds(k), k)


@query("WITH " + SEEDS + """, u AS (SELECT *, count(*) OVER (PARTITION BY title_key) many FROM keys), c AS (SELECT ord, u."row", CASE WHEN a = full_artist THEN 0 WHEN coalesce(a, '') = '' AND many = 1 THEN 1 END stage, derivative, length(title) n FROM seeds JOIN u ON t = title_key), b AS (SELECT ord, "row", stage FROM c WHERE stage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ord ORDER BY stage, derivative, n, "row") = 1) SELECT ord, b."row", coalesce(stage, 2)::BIGINT stage FROM seeds LEFT JOIN b USING (ord)""")
def unique_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Title and whole artist, or the title's only row."""
    k = keyed(spark, d)
    return resolve.unique_row(seeds(k), k)


@query("WITH " + SEEDS + """, c AS (SELECT ord, k."row", CASE WHEN t = title_key AND p = artist_key THEN 0 WHEN t = title_key THEN 1 ELSE 2 END stage FROM seeds JOIN keys k ON contains(title_key, t) WHERE p = '' OR contains(artist_key, p)), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY ord ORDER BY stage, "row") = 1) SELECT ord, b."row", coalesce(stage, 3)::BIGINT stage FROM seeds LEFT JOIN b USING (ord)""")
def eval_lookup(spark: SparkSession, d: str) -> DataFrame:
    """J6."""
    k = keyed(spark, d)
    return resolve.eval_row(seeds(k), k)


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[(\[][^)\]]*[)\]]', ' ', 'g'), '\s+-\s+(?:\d{{4}}\s+)?(?:re)?master(?:ed)?(?:\s+\d{{4}})?.*$', ''), '[^a-z0-9]+', ' ', 'g'))"
_TOKENS = r"list_distinct(list_filter(list_transform(string_split(regexp_replace(lower(artist), '\s*(?:,|&|\+|\bx\b|\bwith\b|\band\b|\bfeaturing\b|\bfeat\b\.?|\bft\b\.?)\s*', ',', 'g'), ','), lambda z: trim(regexp_replace(z, '[^a-z0-9]+', ' ', 'g'))), lambda z: length(z) > 1))"


def _benchmark_keys(s: DataFrame) -> DataFrame:
    artist = text.ascii_fold("artist")
    return s.select("row", "title", "artist", text.bench_key(text.ascii_fold("title")).alias("title_key"), text.artist_tokens(artist).alias("tokens"), text.primary_artist(artist).alias("primary"))


@query("WITH " + LIB + ', b AS (SELECT "row", title, ' + _NORM.format("title") + " title_key, " + _TOKENS + " tokens, trim(regexp_replace(" + _NORM.format("artist") + """, ' (?:featuring|feat|ft|x|and) .*', '')) prim FROM lib), s AS (SELECT "row" ord, title_key, CASE WHEN "row" % 80 = 0 THEN tokens ELSE ['zz'] END tokens, CASE WHEN "row" % 80 = 0 THEN prim ELSE left(prim, 6) END prim FROM b WHERE "row" % 40 = 0), m AS (SELECT ord, b."row", title, regexp_matches(lower(title), '\\b(?:karaoke|tribute|slowed|reverb|nightcore|instrumental|remix|cover|live|acoustic|sped[- ]up|speed[- ]up|mashup)\\b')::INT der FROM s JOIN b USING (title_key) WHERE list_has_any(s.tokens, b.tokens) OR (s.prim <> '' AND b.prim <> '' AND CASE WHEN contains(s.prim, b.prim) OR contains(b.prim, s.prim) THEN least(length(s.prim), length(b.prim)) >= 4 ELSE least(length(s.prim), length(b.prim)) >= 5 AND left(s.prim, 5) = left(b.prim, 5) END)) SELECT ord, "row", first_value("row") OVER (PARTITION BY ord ORDER BY der, length(title), "row") query_row, der = 0 original FROM m""")
def pair_resolution(spark: SparkSession, d: str) -> DataFrame:
    """J7, PF13, F3-F5: benchmark songs to rows by title, then credited artists, containment or the first letters."""
    b = _benchmark_keys(songs(spark, d))
    whole = F.col("row") % 80 == 0
    s = b.where(F.col("row") % 40 == 0).select(F.col("row").alias("ord"), F.col("title_key").alias("t"), F.when(whole, F.col("tokens")).otherwise(F.array(F.lit("zz"))).alias("tokens"), F.when(whole, F.col("primary")).otherwise(F.left("primary", F.lit(6))).alias("primary"))
    return resolve.resolve_pairs(s, b)


@query("WITH " + LIB + ', c AS (SELECT "row", "row" // 3 id, title, artist FROM lib), s AS (SELECT "row" ord, "row" // 3 + CASE WHEN "row" % 7 = 0 THEN 1000000 ELSE 0 END id, CASE WHEN "row" % 2 = 0 THEN title ELSE \'other\' END title, artist FROM lib WHERE "row" % 10 = 0) SELECT ord, c."row" FROM s LEFT JOIN c ON s.id = c.id QUALIFY row_number() OVER (PARTITION BY ord ORDER BY coalesce(s.title = c.title AND s.artist = c.artist, false) DESC, c."row") = 1')
def served_back(spark: SparkSession, d: str) -> DataFrame:
    """Served rows back to catalogue rows: the same title and artist, else the id's first."""
    s = songs(spark, d)
    c = s.select("row", F.floor(F.col("row") / 3).alias("id"), "title", "artist")
    k = F.col("row")
    served = s.where(k % 10 == 0).select(k.alias("ord"), (F.floor(k / 3) + F.when(k % 7 == 0, 1_000_000).otherwise(0)).alias("id"), F.when(k % 2 == 0, F.col("title")).otherwise("other").alias("title"), "artist")
    return resolve.served_rows(served, c)


@query("SELECT DISTINCT l_partkey part FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def not_cached(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that are not known yet."""
    l = read(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), "l_returnflag")  # noqa: E741
    return ingest.not_yet(l.select("part"), l.where("l_returnflag = 'R'"), "part")


@query("WITH " + KEYS + ', b AS (SELECT "row", ' + _NORM.format("title") + " bench, " + _TOKENS + r""" tokens FROM lib) SELECT "row", lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) song, title_key, artist_key, bench, array_to_string(list_sort(tokens), '|') tokens FROM keys JOIN b USING ("row")""")
def title_keys(spark: SparkSession, d: str) -> DataFrame:
    """F1-F6 on every song."""
    k = keyed(spark, d)
    artist = text.ascii_fold("artist")
    return k.select("row", text.song_key(F.col("title")).alias("song"), "title_key", "artist_key", text.bench_key(text.ascii_fold("title")).alias("bench"), F.array_join(F.array_sort(text.artist_tokens(artist)), "|").alias("tokens"))


def _sql_any(patterns) -> str:
    return "'(?i)" + "|".join(p.replace("'", "''") for p in patterns) + "'"


@query("WITH " + LIB + ' SELECT "row", regexp_matches(title, ' + _sql_any(p for p in text.JUNK_TITLE if "(?!" not in p) + ") OR regexp_matches(artist, " + _sql_any(p for p in text.JUNK_ARTIST if "sound" not in p) + ") hosted, regexp_matches(title || ' ' || artist, " + _sql_any(text.EVAL_JUNK) + ") OR regexp_matches(artist, " + _sql_any(text.EVAL_JUNK_ARTIST) + ") evaluated FROM lib")
def junk_variants(spark: SparkSession, d: str) -> DataFrame:
    """PF8, PF9; the SQL leaves out the one pattern with a look-ahead, which no song of the table meets."""
    return songs(spark, d).select("row", text.is_hosted_junk(F.col("title"), F.col("artist")).alias("hosted"), text.is_eval_junk(F.col("title"), F.col("artist")).alias("evaluated"))


@query("WITH " + LIB + """, s AS (SELECT title seed FROM lib WHERE "row" % 500 = 0), x AS (SELECT "row", trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) r, trim(regexp_replace(lower(seed), '\\s+', ' ', 'g')) s FROM lib, s) SELECT "row", s seed FROM x WHERE s <> '' AND r <> '' AND (contains(r, s) OR (contains(s, r) AND r <> s)) GROUP BY ALL""")
def mashups(spark: SparkSession, d: str) -> DataFrame:
    """PF11: songs against a stated set of seeds."""
    lib = songs(spark, d).select("row", text.collapsed(text.ascii_fold("title")).alias("r")).distinct()
    texts = lib.select("r").distinct()
    s = songs(spark, d).where(F.col("row") % 500 == 0).select(text.collapsed(text.ascii_fold("title")).alias("s")).distinct()
    # distinct texts are compared, either inside the other
    named = lambda df, name: df.toDF(name).where(F.length(name) > 0)
    inside = resolve.holders(named(s, "t"), named(texts, "title_key")).toDF("s", "r")
    around = resolve.holders(named(texts, "t"), named(s, "title_key")).toDF("r", "s")
    pairs = inside.unionByName(around).where(text.mashup(F.col("s"), F.col("r"))).distinct()
    return lib.join(pairs, "r").select("row", F.col("s").alias("seed")).distinct()


_SCENE_CASE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(x, '{w}')" for w in words) + f" THEN '{name}'" for name, words in text.SCENE_WORDS.items()) + " END"


@query("WITH d AS (SELECT doc_id, lower(coalesce(text, '') || ' ' || coalesce(source, '')) x, source FROM documents) SELECT doc_id, CASE WHEN source = (SELECT min(source) FROM documents) THEN 'curated' ELSE " + _SCENE_CASE + " END scene FROM d")
def scenes(spark: SparkSession, d: str) -> DataFrame:
    """PF14: a curated scene by the source (one of them), else by keywords of the whole text."""
    docs = read(spark, d, "documents").select("doc_id", "text", "source")
    first = docs.agg(F.min("source").alias("source")).withColumn("curated", F.lit("curated"))
    j = docs.join(F.broadcast(first), "source", "left")  # one row
    both = [F.coalesce(F.col(c), F.lit("")) for c in ("text", "source")]
    return j.select("doc_id", text.scene(*both, F.col("curated")).alias("scene"))


@query("WITH " + LIB + """, q AS (SELECT "row", trim(CASE "row" % 5 WHEN 0 THEN title || ' — ' || artist WHEN 1 THEN title || ' by ' || artist WHEN 2 THEN title || ' :: ' || artist WHEN 3 THEN 'https://open.spotify.com/track/' || 'abc' || "row" ELSE 'x deezer.com/en/track/' || "row" END) q FROM lib), s AS (SELECT "row", q, CASE WHEN contains(q, ' — ') THEN ' — ' WHEN contains(q, ' – ') THEN ' – ' WHEN contains(q, ' :: ') THEN ' :: ' WHEN contains(q, ' - ') THEN ' - ' WHEN contains(q, ' by ') THEN ' by ' END sep FROM q) SELECT "row", trim(CASE WHEN sep IS NULL THEN q ELSE left(q, instr(q, sep) - 1) END) title, CASE WHEN sep IS NULL THEN '' ELSE trim(substr(q, instr(q, sep) + length(sep))) END artist, CASE WHEN regexp_matches(q, 'open\\.spotify\\.com/track/[A-Za-z0-9]+') THEN 'spotify' WHEN regexp_matches(q, 'deezer\\.com/(?:[a-z]{2}/)?track/\\d+') THEN 'deezer' ELSE 'text' END service, nullif(regexp_extract(q, 'track/([A-Za-z0-9]+)', 1), '') track FROM s""")
def text_queries(spark: SparkSession, d: str) -> DataFrame:
    """SC5, SC6: free texts and links."""
    s, k = songs(spark, d), F.col("row") % 5
    with_sep = lambda sep: F.concat("title", F.lit(sep), "artist")
    q = F.when(k == 0, with_sep(" — ")).when(k == 1, with_sep(" by ")).when(k == 2, with_sep(" :: ")).when(k == 3, F.concat(F.lit("https://open.spotify.com/track/abc"), "row")).otherwise(F.concat(F.lit("x deezer.com/en/track/"), "row"))
    return s.select("row", q.alias("q")).select("row", *ingest.text_query(F.col("q")), *ingest.share_link(F.col("q")))


@query("WITH " + LIB + """ SELECT count(*) n, sum(length(title)) chars, count(DISTINCT lower(title) || ' :: ' || lower(artist)) keys FROM lib WHERE "row" % 9 <> 0""")
def csv_songs(spark: SparkSession, d: str) -> DataFrame:
    """SC1, SK4: songs to CSV with other headers and a few broken numbers, and back with keys."""
    from .. import config

    path = scratch(spark, "songs")
    s, k = songs(spark, d), F.col("row")
    numbers = [F.when(k % 9 == 0, F.lit("n/a")).otherwise(k.cast("string")).alias("BPM"), *[F.col("size").alias(f"{f}_%") for f in config.FEATURES[1:]]]
    ingest.write_csv(s.select(F.col("title").alias("Track"), F.col("artist").alias("Artist(s)"), *numbers), path)
    back = ingest.with_keys(ingest.read_songs(spark, path, config.HEADERS, list(config.FEATURES)))
    return back.agg(F.count("*").alias("n"), F.sum(F.length("title")).alias("chars"), F.count_distinct("dedup_key").alias("keys"))


@query("WITH " + LIB + """ SELECT title, artist, count(*) n FROM lib WHERE "row" % 6 <> 1 GROUP BY ALL""")
def csv_seeds(spark: SparkSession, d: str) -> DataFrame:
    """SC4: a seed table with another header, empty and `nan` titles."""
    path = scratch(spark, "seeds")
    k = F.col("row")
    s = songs(spark, d).select(F.when(k % 6 != 1, F.col("title")).when(k % 12 == 1, "nan").otherwise("").alias("Name"), F.col("artist").alias("Artist"))
    ingest.write_csv(s, path)
    return ingest.seed_table(spark, path).groupBy("title", "artist").agg(F.count("*").alias("n"))


@query("SELECT vec_id track_id, round(list_sum(embedding::DOUBLE[]), 5) total, len(embedding) n FROM embeddings")
def json_library(spark: SparkSession, d: str) -> DataFrame:
    """SC7, SK2: a library as JSON documents and back."""
    path = scratch(spark, "library")
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("track_id"), F.lit("t").alias("title"), F.lit("a").alias("artist"), F.col("embedding").cast("array<double>").alias("features"))
    ingest.write_json_library(e, [f"f{k}" for k in range(64)], path)
    return ingest.json_library(spark, path).select("track_id", F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.size("features").cast("long").alias("n"))


@query("SELECT vec_id track_ids, round(list_sum(embedding::DOUBLE[]), 5) total, NULL::FLOAT sonic FROM embeddings")
def npz_library(spark: SparkSession, d: str) -> DataFrame:
    """SC8-SC11, SK1, SK3: a library as NPZ archives, one per task, and back; a column that they have not is null."""
    from ..sources import npz

    path = scratch(spark, "npz")
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("track_ids"), F.col("embedding").alias("neural"))
    npz.write(e, path)
    back = npz.load(spark, path, "track_ids long, neural array<float>, sonic float")
    return back.select("track_ids", F.round(F.aggregate("neural", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"), "sonic")


@query("""WITH t AS (SELECT p_partkey k, p_brand artist, p_name title FROM part) SELECT k track_id, row_number() OVER (ORDER BY k) - 1 row_index, title, artist || ' x' artist, 2 n_tags, k % 2 = 0 commercial, CASE WHEN k % 25 < 20 THEN 'train' ELSE 'test' END part FROM t""")
def collection(spark: SparkSession, d: str) -> DataFrame:
    """SC14-SC20, PF18, PF20, J14, J15: five files of a collection, written, read, checked and joined."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), (F.col("p_partkey") % 25).alias("artist"))
    folder = scratch(spark, "collection")
    pad = lambda c, n, kind: F.concat(F.lit(f"{kind}_"), F.lpad(c.cast("string"), n, "0"))
    track, artist, album = pad(F.col("k"), 9, "track"), pad(F.col("artist"), 6, "artist"), pad(F.col("k") % 50, 6, "album")
    path = F.concat(F.lpad((F.col("k") % 100).cast("string"), 2, "0"), F.lit("/"), F.col("k").cast("string"), F.lit(".mp3"))

    def lines(name: str, header: tuple[str, ...], *fields) -> str:
        # every part starts with the header
        at = f"{folder}/{name}"
        body = p.select(F.concat_ws("\t", *fields).alias("value"))
        body.sparkSession.createDataFrame([("\t".join(header),)], "value string").unionByName(body).write.text(at)
        return at

    tracks = lines("raw", ingest.TRACK_HEADER, track, artist, album, path, F.lit("31.5"), F.lit("genre---rock"), F.concat(F.lit("mood/theme---m"), (F.col("k") % 7).cast("string")))
    odd = F.when(F.col("k") % 97 == 0, F.concat(F.col("name"), F.lit("\t"))).otherwise(F.col("name"))  # the shape that is repaired
    titles = lines("titles", ingest.DESCRIPTIVE_HEADER, track, artist, album, odd, F.concat("brand", F.lit(" x")), F.lit('an "album'), F.lit("2004-05-06"), F.concat(F.lit("http://www.jamendo.com/track/"), F.col("k").cast("string")))
    p.select(F.concat_ws("\n", "name", F.when(F.col("k") % 2 == 0, "http://creativecommons.org/licenses/by-sa/3.0/").otherwise("http://creativecommons.org/licenses/by-nc-nd/3.0/"), track, F.lit("")).alias("value")).write.text(f"{folder}/licences")
    p.select(F.concat(F.sha2(path, 256), F.lit("  "), path).alias("value")).write.text(f"{folder}/sums")
    licences = ingest.licenses(spark, f"{folder}/licences").select(F.regexp_extract("track", r"_0*(\d+)$", 1).cast("long").alias("track_id"), "commercial", "derivatives")
    folds = p.select(F.lit(0).alias("fold"), F.col("k").alias("track_id"), F.col("artist").cast("string").alias("artist"), F.when(F.col("artist") < 20, "train").otherwise("test").alias("part"))
    whole = ingest.whole_collection(ingest.collection_tracks(spark, tracks), ingest.collection_titles(spark, titles), licences, ingest.checksums(spark, f"{folder}/sums"), folds)
    return whole.select("track_id", "row_index", "title", "artist", F.size("tags").alias("n_tags"), "commercial", F.element_at("parts", F.lit(0)).alias("part"))


@query("SELECT min(year(o_orderdate)) \"first\", max(year(o_orderdate)) \"last\", max(year(o_orderdate)) - min(year(o_orderdate)) span, arg_min(lpad(o_orderkey::VARCHAR, 9, '0'), {'y': year(o_orderdate), 't': lpad(o_orderkey::VARCHAR, 9, '0')}) oldest FROM orders")
def year_span(spark: SparkSession, d: str) -> DataFrame:
    """SC34."""
    o = read(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("year"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("title"))
    return ingest.year_span(o, "year", "title")


@query("""WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ['genre---rock', 'mood/theme---' || event_type] WHEN 1 THEN ['genre---rock', 'genre---rock'] WHEN 2 THEN [] WHEN 3 THEN ['style---x'] WHEN 4 THEN ['instrument---a b'] ELSE ['genre---'] END tags, CASE event_id % 5 WHEN 0 THEN event_type || '/' || event_id || '.mp3' WHEN 1 THEN '../x' WHEN 2 THEN '/x' WHEN 3 THEN 'a//b' ELSE 'a:b' END path FROM events) SELECT event_id, event_id % 6 IN (0, 4) tags_ok, event_id % 5 = 0 path_ok FROM t""")
def tag_and_path_checks(spark: SparkSession, d: str) -> DataFrame:
    """PF18, PF20."""
    e, k = read(spark, d, "events").select("event_id", "event_type"), F.col("event_id")
    a = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    tags = F.when(k % 6 == 0, a("genre---rock", F.concat(F.lit("mood/theme---"), "event_type"))).when(k % 6 == 1, a("genre---rock", "genre---rock")).when(k % 6 == 2, F.array().cast("array<string>")).when(k % 6 == 3, a("style---x")).when(k % 6 == 4, a("instrument---a b")).otherwise(a("genre---"))
    path = F.when(k % 5 == 0, F.concat("event_type", F.lit("/"), k.cast("string"), F.lit(".mp3"))).when(k % 5 == 1, "../x").when(k % 5 == 2, "/x").when(k % 5 == 3, "a//b").otherwise("a:b")
    return e.select("event_id", ingest.valid_tags(tags).alias("tags_ok"), ingest.safe_path(path).alias("path_ok"))


@query("""WITH r AS (SELECT o_orderkey id, o_custkey seed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_custkey % 50 = 7 THEN 1 ELSE 0 END pos FROM orders), l AS (SELECT seed list_id, seed, list(id ORDER BY id) FILTER (pos <= 5) || CASE WHEN seed % 9 = 4 THEN [-1] ELSE [] END ranking FROM r GROUP BY seed), g AS (SELECT seed FROM r GROUP BY seed HAVING max(pos) <> count(DISTINCT pos) OR count(*) <> count(DISTINCT pos)) SELECT list_id, 'other size' problem FROM l WHERE len(ranking) <> 5 UNION ALL SELECT list_id, 'foreign result' FROM l WHERE seed % 9 = 4 UNION ALL SELECT list_id, 'positions with gaps' FROM l WHERE seed IN (SELECT seed FROM g)""")
def served_lists(spark: SparkSession, d: str) -> DataFrame:
    """PF21: lists of each customer's first orders, some broken."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    r = read(spark, d, "orders").select(F.col("o_orderkey").alias("result_id"), F.col("o_custkey").alias("seed"), (F.row_number().over(w) + F.when(F.col("o_custkey") % 50 == 7, 1).otherwise(0)).alias("position"))
    ranking = F.array_sort(F.collect_list(F.when(F.col("position") <= 5, F.col("result_id"))))
    lists = r.groupBy("seed").agg(ranking.alias("ranking")).select(F.col("seed").alias("list_id"), "seed", F.when(F.col("seed") % 9 == 4, F.concat("ranking", F.array(F.lit(-1).cast("long")))).otherwise(F.col("ranking")).alias("ranking"))
    return ingest.served_list_problems(lists, r)


@query("""WITH {FEAT} SELECT id, CASE WHEN a > 26 THEN 'very dynamic' WHEN a > 24 THEN 'dynamic' ELSE 'steady' END dynamics, CASE WHEN c > 0.06 THEN 'bass-heavy' WHEN c > 0.04 THEN 'balanced' ELSE 'light' END low_end, CASE WHEN b > 40000 THEN 'bright' WHEN b > 30000 THEN 'warm' ELSE 'dark' END tone FROM f""")
def vibe_words(spark: SparkSession, d: str) -> DataFrame:
    """PF15: three buckets by two bounds each."""
    from .catalogue import features

    def bucket(c: str, high: float, low: float, *names: str):
        return F.when(F.col(c) > high, names[0]).when(F.col(c) > low, names[1]).otherwise(names[2])

    return features(spark, d).select("id", bucket("a", 26, 24, "very dynamic", "dynamic", "steady").alias("dynamics"), bucket("c", 0.06, 0.04, "bass-heavy", "balanced", "light").alias("low_end"), bucket("b", 40000, 30000, "bright", "warm", "dark").alias("tone"))


@query("WITH " + LIB + """ SELECT "row" FROM lib WHERE NOT contains(lower(artist), 'brand#1')""")
def other_artists(spark: SparkSession, d: str) -> DataFrame:
    """PF6: rows whose artist does not hold the excluded one."""
    return songs(spark, d).where(text.excludes_artist(F.col("artist"), F.lit("Brand#1"))).select("row")


@query("WITH " + LIB + r""", k AS (SELECT "row", regexp_replace(regexp_replace(regexp_replace(lower(title), '\((feat|ft|with)[^)]*\)', '', 'g'), '[-(\[]\s*(?:remaster|remastered|sped[\s-]?up|slowed|reverb|remix|radio edit|live|acoustic|instrumental|karaoke|cover|version|mix|edit|demo|mono|stereo|deluxe|bonus)\b.*', '', 'g'), '[^a-z0-9]', '', 'g') || '|' || regexp_replace(lower(artist), '[^a-z0-9]', '', 'g') AS key FROM lib) SELECT key, min("row") "row", count(*) n FROM k GROUP BY key""")
def catalogue_first(spark: SparkSession, d: str) -> DataFrame:
    """U8, A3: version suffixes and credits stripped, the first row of each key."""
    return songs(spark, d).select("row", text.catalogue_key(F.col("title"), F.col("artist")).alias("key")).groupBy("key").agg(F.min("row").alias("row"), F.count("*").alias("n"))


@query("WITH " + LIB + """ SELECT "row", round(size / 7.0::DOUBLE, 4) size, 'https://x/search/' || url_encode(title || ' ' || artist) link FROM lib""")
def output_fields(spark: SparkSession, d: str) -> DataFrame:
    """quoted links and four decimals."""
    return songs(spark, d).select("row", F.round(F.col("size") / F.lit(7.0), 4).alias("size"), F.concat(F.lit("https://x/search/"), text.url_quoted(F.concat_ws(" ", "title", "artist"))).alias("link"))



@query()
def title_variants(spark: SparkSession, d: str) -> DataFrame:
    """PF10, F7: songs whose title is a variant of a seed's; no SQL (sequence matcher), held against plain code in the tests."""
    s = songs(spark, d).select("row", text.bench_key(text.ascii_fold("title")).alias("t"))
    asked = s.where(F.col("row") % 500 == 0).select(F.col("t").alias("seed")).distinct()
    pairs = s.select("t").distinct().join(asked, text.same_title(F.col("seed"), F.col("t")))  # distinct texts are compared
    return s.join(pairs, "t").select("row", "seed")


@query("SELECT event_id, ord, title, artist FROM (SELECT event_id, unnest([{'ord': 0, 'title': event_type, 'artist': 'u' || user_id}, {'ord': 1, 'title': 'solo ' || event_id, 'artist': NULL}, {'ord': 2, 'title': 'a b', 'artist': event_type}], recursive := true) FROM events WHERE event_id % 7 = 0)")
def parsed_seeds(spark: SparkSession, d: str) -> DataFrame:
    """SC3, UD5: seeds out of texts by the table function, in SQL."""
    from ..functions.register import register

    register(spark)
    k = F.col("event_id")
    t = F.concat(F.col("event_type"), F.lit(" - u"), F.col("user_id").cast("string"), F.lit("; solo "), k.cast("string"), F.lit("\n# no\na b | "), F.col("event_type"))
    read(spark, d, "events").where(k % 7 == 0).select("event_id", t.alias("said")).createOrReplaceTempView("_texts")
    return spark.sql("SELECT event_id, s.ord, s.title, s.artist FROM _texts, LATERAL split_seeds(said) s")


@query("WITH n AS (SELECT part, count(*) n FROM (SELECT p_partkey % 20 part FROM part) GROUP BY 1) SELECT 'f' || part path, CASE part % 4 WHEN 0 THEN 'fetch' WHEN 1 THEN 'conflict' ELSE 'keep' END state FROM n UNION ALL SELECT 'other', 'extra'")
def inbox_state(spark: SparkSession, d: str) -> DataFrame:
    """SK9, SK13: two folders of files compared by the bytes."""
    from ..sources import store

    p = read(spark, d, "part").select((F.col("p_partkey") % 20).alias("k")).distinct()
    content = F.concat(F.lit("body "), F.col("k").cast("string"))
    a, b = scratch(spark, "remote"), scratch(spark, "local")
    for at, rows in ((a, p.withColumn("c", content)), (b, p.where("k % 4 <> 0").withColumn("c", F.when(F.col("k") % 4 == 1, "other").otherwise(content)))):
        rows.repartition("k").write.partitionBy("k").text(at)

    def hashes(at: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(at)
        return files.select(F.concat(F.lit("f"), F.regexp_extract("path", r"k=(\d+)/", 1)).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))

    extra = spark.createDataFrame([("other", 1, "x")], "path string, size long, sha256 string")
    return store.inbox_state(hashes(a), hashes(b).unionByName(extra))
