"""Reports, library state, refusals and the nomination of pixel originals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.operators import pairing
from tidemark.plans import plan, reports
from tidemark.queries import planning
from tidemark.registry import query, table
from tidemark.sources import library
from tidemark.streaming import journal


@query(planning._JOURNAL_SQL + """, r AS (SELECT run_id, bool_or(kind = 'done') AND NOT bool_or(dry) AND (run_id LIKE '%2' OR run_id LIKE '%3') AS undoable FROM j GROUP BY run_id),
a AS (SELECT DISTINCT 'r' || (user_id * 2) AS run_id FROM events)
SELECT a.run_id, CASE WHEN undoable IS NULL THEN 'not-found' WHEN NOT undoable THEN 'not-undoable' END AS reason FROM a LEFT JOIN r ON a.run_id = r.run_id""")
def undo_refusals(spark, sf_dir):
    """Why a run can't be undone; the runs asked for are twice the users' ids, so that some don't exist."""
    records = planning._records(spark, sf_dir)
    backed = records.select("run_id").filter("run_id LIKE '%2' OR run_id LIKE '%3'")
    asked = table(spark, sf_dir, "events").select(F.concat(F.lit("r"), (F.col("user_id") * 2).cast("string")).alias("run_id"))
    return journal.refusals(asked, journal.run_history(records, backed))


@query(planning._JOURNAL_SQL + """, l AS (SELECT run_id, src, dst, arg_max(kind, seq) AS kind FROM j WHERE kind IN ('moved', 'error') GROUP BY 1, 2, 3)
SELECT src, dst, '  ' || src || ': broken' AS line, run_id FROM l WHERE kind = 'error'""")
def failed_moves(spark, sf_dir):
    """K8: the lines of what the runs could not move, of every run."""
    records = planning._records(spark, sf_dir).withColumn("error", F.lit("broken"))
    return reports.failures_of_runs(records).select(F.col("from").alias("src"), F.col("to").alias("dst"), "line", "run_id")


@query(planning._BUCKET_SQL + """ SELECT k AS o_orderkey, '  ' || path || ' -> ' || target || ' [' || why || CASE WHEN k % 13 = 5 THEN '; copy of first' ELSE '' END || CASE WHEN k % 17 = 0 THEN '; renamed, the name was taken' ELSE '' END || ']' AS line FROM b""")
def plan_lines(spark, sf_dir):
    """K7: the line of each order's move in a plan's report."""
    from tidemark.plans import buckets

    k = F.col("k")
    rows = planning._bucketed(spark, sf_dir).select(k, F.col("path").alias("from"), buckets.target().alias("to"), F.col("why").alias("reason"), F.when(k % 13 == 5, "first").alias("duplicate_of"), (k % 17 == 0).alias("collision_renamed"))
    return reports.operation_lines(rows).join(rows.select("k", "from", "to"), ["from", "to"]).select(k.alias("o_orderkey"), "line")


@query(planning._BUCKET_SQL + " SELECT path, target FROM b WHERE NOT (k % 5 = 0 AND why <> 'copy')")
def moves_done(spark, sf_dir):
    """The moves of a plan without the failed ones (every fifth order's, copies aside)."""
    from tidemark.plans import buckets

    rows = planning._bucketed(spark, sf_dir).select("k", "why", F.col("path").alias("from"), buckets.target().alias("to"))
    return reports.remaining(rows, rows.filter("k % 5 = 0 AND why <> 'copy'")).select(F.col("from").alias("path"), F.col("to").alias("target"))


@query("""
SELECT year(o_orderdate)::VARCHAR AS year, (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 3) AS inbox FROM orders GROUP BY 1
""")
def library_state(spark, sf_dir):
    """Year folders of a library of orders, and the files in its inbox (orders whose key ends in 3)."""
    orders = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate").cast("string")
    files = orders.select(F.concat_ws("/", F.when(F.col("o_orderkey") % 10 == 3, "НОВОЕ"), year, F.col("o_orderkey").cast("string")).alias("path"))
    dirs = orders.select(F.explode(F.array(year, F.concat(year, F.lit("x")), F.concat(year, F.lit("/in")), F.concat(F.lit("2"), year))).alias("dir"))
    return library.years(dirs).crossJoin(library.inbox(dirs, files).select(F.col("files").alias("inbox")))  # one row


@query(planning._PAGES_SQL + """, d AS (SELECT dir FROM s GROUP BY dir HAVING count(DISTINCT place) > 1)
SELECT count(*) FILTER (WHERE dir NOT IN ('misc', '12345/tmp')) AS pending, count(*) FILTER (WHERE dir IN ('misc', '12345/tmp')) AS answered FROM d""")
def pending_decisions(spark, sf_dir):
    """Folders that need a decision and have none."""
    assets = planning._page_assets(spark, sf_dir)
    answers = spark.createDataFrame([("misc", "sort"), ("12345/tmp", "as-is"), ("elsewhere", "sort")], "dir string, decision string")
    return library.pending(plan.scattered(plan.suspicious_of(assets), assets), answers)


@query("""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'camera unknown' ELSE 'family ' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' (by the size of the frame)' ELSE '' END ||
  CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 4 = 1 THEN ', neighbours of the same camera: 2011' ELSE ', neighbours of the same camera: 2011–' || (2011 + p_size % 4 - 1) END END ||
  CASE WHEN p_size % 7 = 0 THEN ', taken no later than 2014-02' ELSE '' END AS phrase FROM part
""")
def family_phrases(spark, sf_dir):
    """what is known of the camera; brands are models, sizes decide what else is known."""
    size, first = F.col("p_size"), F.lit(2011)
    first = F.when(size % 3 != 0, first)
    last = F.when(size % 4 == 1, first).otherwise(first + size % 4 - 1)
    phrase = reports.family_phrase(F.when(size % 5 != 0, F.col("p_brand")), F.when(size % 2 == 0, "geometry").otherwise("exif"), first, last, F.when(size % 7 == 0, "2014-02"))
    return table(spark, sf_dir, "part").select("p_partkey", phrase.alias("phrase"))


@query("""
WITH g AS (SELECT c_custkey AS k, n_nationkey AS n, n_regionkey AS r, c_mktsegment AS seg, '20' || lpad((10 + c_custkey % 9)::VARCHAR, 2, '0') || '-05-01' AS day, lpad(c_custkey::VARCHAR, 9, '0') AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
q AS (SELECT *, CASE WHEN k % 3 > 0 THEN seg END AS model, CASE WHEN k % 4 > 0 THEN '2014-06' END AS latest FROM g WHERE k % 50 = 0),
p AS (SELECT q.k AS query, c.k AS candidate, c.name, CASE WHEN c.n = q.n THEN 0 WHEN c.r = q.r THEN 1 ELSE 2 END AS nearest FROM q JOIN g c ON (q.model IS NULL OR c.k % 11 = 0 OR q.model = c.seg) AND (q.latest IS NULL OR c.day[:7] <= q.latest)),
s AS (SELECT query, count(*) FILTER (WHERE nearest = 0) AS a, count(*) FILTER (WHERE nearest <= 1) AS b, count(*) AS c FROM p GROUP BY query),
l AS (SELECT query, CASE WHEN a >= 3 THEN 0 WHEN b >= 3 THEN 1 ELSE 2 END AS level, CASE WHEN a >= 3 THEN a WHEN b >= 3 THEN b ELSE c END AS available FROM s WHERE c >= 3)
SELECT l.query, level, available, count(*) AS compared, max(candidate) AS last FROM (
  SELECT l.*, p.candidate, row_number() OVER (PARTITION BY l.query ORDER BY CASE WHEN level = 0 THEN '' ELSE lpad(c.r::VARCHAR, 2, '0') || lpad(c.n::VARCHAR, 2, '0') END, p.name) AS place FROM l JOIN p ON p.query = l.query AND nearest <= level JOIN g c ON c.k = p.candidate) l
WHERE place <= 500 GROUP BY 1, 2, 3
""")
def nominate_originals(spark, sf_dir):
    """Photos that could be the original of saved pictures (customers divisible by 50, in folders of region and nation), the first 500 of a pool and its whole size."""
    k, two = F.col("c_custkey"), lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.concat_ws("/", two("n_regionkey"), two("n_nationkey"), F.lpad(k.cast("string"), 9, "0"))
    found = pairing.nominate(
        rows.filter(k % 50 == 0).select(path.alias("path"), F.when(k % 3 > 0, F.col("c_mktsegment")).alias("model"), F.when(k % 4 > 0, "2014-06").alias("latest")),
        rows.select(path.alias("path"), F.when(k % 11 > 0, F.col("c_mktsegment")).alias("model"), F.concat(F.lit("20"), (k % 9 + 10).cast("string"), F.lit("-05-01")).alias("day")),
    )
    key = lambda c: paths.base_of(F.col(c)).cast("long")
    return found.groupBy(key("query").alias("query"), F.col("level").cast("int").alias("level"), "available").agg(F.count("*").alias("compared"), F.max(key("candidate")).alias("last"))
