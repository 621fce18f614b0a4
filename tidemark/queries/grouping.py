"""Pairs, groups, keepers and nearest candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators import corpus, dedupe, nearest, pairing, similarity
from tidemark.registry import query, table

_CENSUS_SQL = """
WITH census AS (SELECT c_nationkey AS dir, p_brand AS model, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year, count(*) AS neighbours
  FROM part JOIN orders ON p_partkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 > 0 GROUP BY 1, 2),
sides AS (SELECT DISTINCT c_nationkey AS dir, p_brand AS model, unnest([p_size, p_size + 7]) AS side FROM part JOIN orders ON p_partkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 > 0)"""


def _photos(spark, sf_dir):
    """Parts as photos (brand: camera, size: sides), in the directory of the nation that ordered under their number."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = table(spark, sf_dir, "part").join(orders, F.col("p_partkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.concat_ws("/", F.col("c_nationkey"), F.col("p_partkey")).alias("path"), F.col("p_brand").alias("model"), F.col("p_size").alias("width"), (F.col("p_size") + 7).alias("height"), F.year("o_orderdate").alias("year"), F.col("p_partkey").alias("k"), F.col("c_nationkey").cast("string").alias("dir"))


def _census(photos):
    verdicts = photos.filter("k % 3 > 0").select("path", "year", F.lit("exif-original").alias("winner"), F.lit("high").alias("confidence"))
    return corpus.camera_census(verdicts, photos.select("path", "model", "width", "height"))


@query(_CENSUS_SQL + " SELECT c.dir::VARCHAR AS dir, c.model, first_year::INT AS first_year, last_year::INT AS last_year, neighbours, n_sides, sum_sides FROM census c JOIN (SELECT dir, model, count(*) AS n_sides, sum(side)::BIGINT AS sum_sides FROM sides GROUP BY 1, 2) s ON c.dir = s.dir AND c.model = s.model")
def camera_census(spark, sf_dir):
    """The cameras of each directory, with the years and sides of their confident photos."""
    found = _census(_photos(spark, sf_dir))
    total = F.aggregate("sides", F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("dir", "model", "first_year", "last_year", "neighbours", F.size("sides").cast("long").alias("n_sides"), total.alias("sum_sides"))


@query(_CENSUS_SQL + """
, q AS (SELECT p_partkey AS k, c_nationkey AS dir, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS model, p_size AS w FROM part JOIN orders ON p_partkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0),
own AS (SELECT k, q.model, 'exif' AS matched_by FROM q JOIN census c ON c.dir = q.dir AND c.model = q.model),
hits AS (SELECT q.k, min(s.model) AS model, count(DISTINCT s.model) AS n FROM q JOIN sides s ON s.dir = q.dir AND s.side IN (q.w, q.w + 7) JOIN census c ON c.dir = s.dir AND c.model = s.model AND c.neighbours >= 3
  WHERE q.k NOT IN (SELECT k FROM own) GROUP BY q.k)
SELECT * FROM own UNION ALL SELECT k, model, 'geometry' FROM hits WHERE n = 1
""")
def family_match(spark, sf_dir):
    """Photos without a date find the camera of their directory by model or by the only fitting side."""
    photos = _photos(spark, sf_dir)
    queries = photos.filter("k % 3 = 0").select("path", "dir", F.when(F.col("k") % 2 == 0, F.col("model")).alias("model"), "width", "height")
    found = pairing.family_match(queries, _census(photos), V.FAMILY_NEIGHBOURS)
    return found.select(F.substring_index("path", "/", -1).cast("long").alias("k"), "model", "matched_by")


@query("""
WITH p AS (SELECT c_nationkey || '/' || p_partkey AS path, c_nationkey AS dir, CASE WHEN p_partkey % 4 > 0 THEN p_brand || p_size % 6 END AS model, p_size AS w, year(o_orderdate) AS year, p_partkey % 5 > 0 AS sure
  FROM part JOIN orders ON p_partkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
others AS (SELECT q.path, c.model, count(*) AS neighbours, min(c.year) AS first_year, max(c.year) AS last_year, q.model IS NOT DISTINCT FROM c.model AS own, bool_or(c.w IN (q.w, q.w + 7) OR c.w + 7 IN (q.w, q.w + 7)) AS fits
  FROM p q JOIN p c ON c.dir = q.dir AND c.path <> q.path AND c.sure AND c.model IS NOT NULL GROUP BY q.path, q.model, c.model),
named AS (SELECT path, model, neighbours, first_year, last_year, 'exif' AS matched_by FROM others WHERE own),
shaped AS (SELECT path, any_value(model) AS model, any_value(neighbours) AS neighbours, any_value(first_year) AS first_year, any_value(last_year) AS last_year, 'geometry' AS matched_by FROM others
  WHERE neighbours >= 3 AND fits AND path NOT IN (SELECT path FROM named) GROUP BY path HAVING count(*) = 1)
SELECT path, model, matched_by, neighbours, first_year::INT AS first_year, last_year::INT AS last_year FROM (SELECT * FROM named UNION ALL SELECT * FROM shaped)
""")
def family_of_others(spark, sf_dir):
    """Every photo's camera as the others of its directory know it, although four fifths of the photos are counted themselves."""
    photos = _photos(spark, sf_dir).withColumn("model", F.when(F.col("k") % 4 > 0, F.concat("model", (F.col("width") % 6).cast("string")))).withColumn("sure", F.col("k") % 5 > 0)
    verdicts = photos.filter("sure").select("path", "year", F.lit("dirname").alias("winner"), F.lit("medium").alias("confidence"))
    census = corpus.camera_census(verdicts, photos.select("path", "model", "width", "height"))
    queries = photos.select("path", "dir", "model", "width", "height", F.when(F.col("sure") & F.col("model").isNotNull(), F.col("year")).alias("own_year"))
    return pairing.family_match(queries, census).select("path", "model", "matched_by", "neighbours", "first_year", "last_year")


_ASSETS_SQL = """
WITH media AS (SELECT 'd' || (p_partkey % 40) || '/' || CASE WHEN p_partkey % 3 = 0 THEN 'M' ELSE 'm' END || (p_partkey // 2) || CASE p_partkey % 2 WHEN 0 THEN '.jpg' ELSE '.avi' END AS path FROM part WHERE p_size > 10),
side AS (SELECT 'd' || (p_partkey % 40) || '/m' || (p_partkey // 2) || CASE p_partkey % 3 WHEN 0 THEN '.jpg.xmp' ELSE '.THM' END AS path FROM part WHERE p_size % 2 = 0),
m AS (SELECT path, split_part(path, '/', 1) AS dir, lower(split_part(path, '/', 2)) AS name FROM media),
s AS (SELECT DISTINCT path AS sidecar, split_part(path, '/', 1) AS dir, lower(regexp_replace(split_part(path, '/', 2), '[.][^.]*$', '')) AS key FROM side),
exact AS (SELECT dir, name AS key, max(path) AS path FROM m GROUP BY 1, 2),
lone AS (SELECT dir, regexp_replace(name, '[.][^.]*$', '') AS key, min(path) AS path, count(*) AS n FROM m GROUP BY 1, 2)"""


def _sidecar_assets(spark, sf_dir):
    """Parts as media files and sidecars in forty directories, with mixed case and shared stems."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    half = F.floor(k / 2)
    media = part.filter("p_size > 10").select(c("d", k % 40, "/", F.when(k % 3 == 0, "M").otherwise("m"), half, F.when(k % 2 == 0, ".jpg").otherwise(".avi")).alias("path"), F.lit("photo").alias("kind"))
    side = part.filter("p_size % 2 = 0").select(c("d", k % 40, "/m", half, F.when(k % 3 == 0, ".jpg.xmp").otherwise(".THM")).alias("path"), F.lit("other").alias("kind")).distinct()
    return media.unionByName(side)


@query(_ASSETS_SQL + " SELECT sidecar, e.path FROM s JOIN exact e ON e.dir = s.dir AND e.key = s.key")
def pair_exact(spark, sf_dir):
    """Sidecars whose stem is a media file's full name."""
    pairs = pairing.pair_sidecars(_sidecar_assets(spark, sf_dir))
    return pairs.filter(F.lower(F.regexp_replace(F.substring_index("sidecar", "/", -1), r"\.[^.]*$", "")) == F.lower(F.substring_index("path", "/", -1)))


@query(_ASSETS_SQL + " SELECT sidecar, coalesce(e.path, l.path) AS path FROM s LEFT JOIN exact e ON e.dir = s.dir AND e.key = s.key LEFT JOIN lone l ON l.dir = s.dir AND l.key = s.key AND l.n = 1 WHERE coalesce(e.path, l.path) IS NOT NULL")
def pair_unique(spark, sf_dir):
    """Sidecars paired by full name, else by a stem that one file alone has."""
    return pairing.pair_sidecars(_sidecar_assets(spark, sf_dir))


@query("""
WITH facts AS (SELECT doc_id AS k, sha256(coalesce(text, '')) AS did FROM documents),
known AS (SELECT f.did, min_by(f.k, f.k::VARCHAR) AS original, min_by(quality, f.k::VARCHAR) AS quality FROM facts f JOIN labels l ON l.doc_id = f.k GROUP BY f.did)
SELECT k AS doc_id, original, quality FROM facts JOIN known ON facts.did = known.did WHERE k <> original
""")
def derive_original(spark, sf_dir):
    """Documents inherit the quality label of the first labelled one with the same text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("document_id"))
    facts = docs.withColumn("derived_from", F.col("document_id"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"), "quality")
    return pairing.originals_of(facts, labels).select(F.col("path").cast("long").alias("doc_id"), F.col("original").cast("long").alias("original"), "quality")


_GROUPS_SQL = """
WITH a AS (SELECT sha256(coalesce(text, '')) AS h, doc_id,
  CASE doc_id % 4 WHEN 0 THEN 'НОВОЕ/' WHEN 1 THEN 'a/' WHEN 2 THEN 'a/b/' ELSE '' END || 'd' || lpad(doc_id::VARCHAR, 9, '0') || CASE WHEN doc_id % 5 = 0 THEN ' copy' ELSE '' END || '.txt' AS path,
  (doc_id % 3)::INT AS s0, (doc_id % 2)::INT AS s1, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS s2, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS s3,
  CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS s4 FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY s0, s1, s2, s3, s4, path) AS p, count(*) OVER (PARTITION BY h) AS n FROM a),
k AS (SELECT * FROM r WHERE p = 1 AND n > 1)"""


def _duplicates(spark, sf_dir):
    """Documents as files: equal texts are equal contents; statuses and places follow from the id."""
    k = F.col("doc_id")
    place = F.when(k % 4 == 0, "НОВОЕ/").when(k % 4 == 1, "a/").when(k % 4 == 2, "a/b/").otherwise("")
    path = F.concat(place, F.lit("d"), F.lpad(k.cast("string"), 9, "0"), F.when(k % 5 == 0, " copy").otherwise(""), F.lit(".txt"))
    status = F.when(k % 3 == 0, "dated").when(k % 3 == 1, "partial").otherwise("unknown")
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.lit("photo").alias("kind"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), status.alias("status"), (k % 2 == 1).alias("assumed"))


@query(_GROUPS_SQL + " SELECT h AS sha256, path AS keeper, n FROM k")
def dup_groups(spark, sf_dir):
    """Groups of equal documents and the keeper of each."""
    rows = _duplicates(spark, sf_dir)
    return dedupe.duplicate_groups(rows.select("path", "kind", "sha256"), rows.select("path", "status", "assumed")).select("sha256", "keeper", "n")


@query(_GROUPS_SQL + " SELECT r.path, k.path AS keeper FROM r JOIN k ON r.h = k.h AND r.path <> k.path")
def dup_keeper(spark, sf_dir):
    """Every copy with its keeper."""
    rows = _duplicates(spark, sf_dir)
    return dedupe.copies(rows, dedupe.duplicate_groups(rows.select("path", "kind", "sha256"), rows.select("path", "status", "assumed")))


@query(_GROUPS_SQL + """
, d AS (SELECT k.h, k.path, bool_or(r.s0 <> k.s0) AS d0, bool_or(r.s0 = k.s0 AND r.s1 <> k.s1) AS d1, bool_or(r.s0 = k.s0 AND r.s1 = k.s1 AND r.s2 <> k.s2) AS d2,
  bool_or(r.s0 = k.s0 AND r.s1 = k.s1 AND r.s2 = k.s2 AND r.s3 <> k.s3) AS d3, bool_or(r.s0 = k.s0 AND r.s1 = k.s1 AND r.s2 = k.s2 AND r.s3 = k.s3 AND r.s4 <> k.s4) AS d4,
  count(*) FILTER (WHERE r.s0 = k.s0 AND r.s1 = k.s1 AND r.s2 = k.s2 AND r.s3 = k.s3 AND r.s4 = k.s4) AS same FROM k JOIN r ON r.h = k.h GROUP BY 1, 2)
SELECT h AS sha256, concat_ws('; далее — ', CASE WHEN d0 THEN 'у него самая надёжная дата' END, CASE WHEN d1 THEN 'его дата установлена, а не предположена' END, CASE WHEN d2 THEN 'его имя не помечено как копия' END,
 CASE WHEN d3 THEN 'он уже разложен в библиотеке, а второй только что попал в папку «НОВОЕ»' END, CASE WHEN d4 THEN 'он лежит ближе всех к верху дерева папок' END, CASE WHEN same > 1 THEN 'первый по порядку пути — всё остальное у них одинаково' END) AS reason FROM d
""")
def keeper_reason(spark, sf_dir):
    """The criteria that decided on each keeper, in order."""
    rows = _duplicates(spark, sf_dir)
    return dedupe.duplicate_groups(rows.select("path", "kind", "sha256"), rows.select("path", "status", "assumed")).select("sha256", "reason")


_BITS_SQL = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
pairs AS (SELECT q.vec_id AS query, c.vec_id AS candidate, c.label AS day,
  list_sum(list_transform(list_zip(q.b, c.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::INT AS distance FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)"""


def _nearest(spark, sf_dir, rival=False):
    """Every vector whose id is divisible by 50 as a query (the stated query set) against all others."""
    bits = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("day"), similarity.sign_bits(F.col("embedding")).alias("bits"))
    return nearest.nearest(bits.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "bits"), bits.withColumnRenamed("vec_id", "candidate"), similarity.TOP, words=2, bits=32, rival=rival)


@query(_BITS_SQL + " SELECT query, candidate, distance, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, candidate) AS place FROM pairs) WHERE place <= 5")
def coarse_topk(spark, sf_dir):
    """The five nearest vectors of each query by the signs of their elements."""
    return _nearest(spark, sf_dir).select("query", "candidate", "distance", F.col("place").cast("long").alias("place"))


@query(_BITS_SQL + """
, p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, candidate) AS place, first_value(day) OVER (PARTITION BY query ORDER BY distance, candidate) AS best_day, count(*) OVER (PARTITION BY query) AS total FROM pairs),
f AS (SELECT *, min(CASE WHEN day <> best_day THEN place END) OVER (PARTITION BY query) AS rival FROM p),
s AS (SELECT * FROM f WHERE place <= 5 OR place = rival),
b AS (SELECT query, arg_min(candidate, place) AS best, arg_min(day, place) AS day, min(distance) AS distance, min(CASE WHEN day <> best_day THEN distance END) - min(distance) AS margin, max(total) AS compared FROM s GROUP BY query)
SELECT query, best, day, distance, margin, compared >= 3 AND distance <= 24 AND coalesce(margin >= 1, true) AS decisive FROM b
""")
def margin_decide(spark, sf_dir):
    """The nearest vector, decisive if its margin to the best one of another label is large enough (limits rescaled to 64 bits)."""
    found = similarity.decide_by_margin(_nearest(spark, sf_dir, rival=True), "query", "candidate", "distance", "day", max_distance=24, min_margin=1)
    return found.select("query", "best", "day", "distance", "margin", "decisive")


@query("""
WITH g AS (SELECT c_custkey AS k, c_nationkey AS n0, n_regionkey AS n1, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey),
q AS (SELECT k, n0, n1, 0 AS n2 FROM g WHERE k % 50 = 0), c AS (SELECT k, n0, n1, 0 AS n2 FROM g),
l AS (SELECT q.k AS query, q.n0, q.n1, (SELECT count(*) FROM c WHERE c.n0 = q.n0) AS a, (SELECT count(*) FROM c WHERE c.n1 = q.n1) AS b, (SELECT count(*) FROM c) AS t FROM q),
f AS (SELECT *, CASE WHEN a >= 12 THEN 0 WHEN b >= 12 THEN 1 WHEN t >= 12 THEN 2 END AS level FROM l)
SELECT query, level, count(*) AS pool, min(c.k) AS first FROM f JOIN c ON c.k <> f.query AND ((level = 0 AND c.n0 = f.n0) OR (level = 1 AND c.n1 = f.n1) OR level = 2) GROUP BY query, level
""")
def nominate_widen(spark, sf_dir):
    """For customers whose key is divisible by 50, all others from their nation, else region, else everywhere: the first level with at least 12."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n0"), F.col("n_regionkey").alias("n1"), F.lit(0).alias("n2"))
    found = pairing.widening_pool(rows.filter("k % 50 = 0").withColumnRenamed("k", "query"), rows.withColumnRenamed("k", "candidate"), ["n0", "n1", "n2"], 12)
    return found.filter("candidate <> query").groupBy("query", "level").agg(F.count("*").alias("pool"), F.min("candidate").alias("first"))
