"""Destinations, held folders, collisions, emptied folders, event logs and the scan cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, paths
from tidemark.functions.dates import WALL
from tidemark.plans import buckets, conservation, plan
from tidemark.registry import query, table
from tidemark.sources import cache, changes
from tidemark.streaming import journal

_BUCKET_SQL = """
WITH a AS (SELECT o_orderkey AS k, o_orderdate AS d, 'Trip ' || (o_orderkey % 3) || '/2001/' || 'f' || o_orderkey || '.x' AS path,
  CASE o_orderkey % 11 WHEN 0 THEN 'junk' WHEN 1 THEN 'other' WHEN 2 THEN 'video' WHEN 3 THEN 'audio' ELSE 'photo' END AS kind, o_orderkey % 13 = 5 AS is_copy,
  CASE o_orderkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'partial' ELSE 'dated' END AS status, o_orderkey % 10 = 1 AS assumed,
  CASE o_orderkey % 4 WHEN 0 THEN 'лето' WHEN 1 THEN 'зима' WHEN 2 THEN 'осень' END AS season, year(o_orderdate) AS y FROM orders),
w AS (SELECT *, CASE WHEN is_copy THEN 'copy' WHEN kind IN ('junk', 'other') THEN kind WHEN status = 'unknown' THEN 'unknown' WHEN assumed THEN 'assumed'
  WHEN status = 'partial' AND season IN ('лето', 'осень') THEN 'partial-season' WHEN status = 'partial' THEN 'partial-year' ELSE 'dated' END AS why FROM a),
t AS (SELECT *, CASE kind WHEN 'video' THEN 'видео/' WHEN 'audio' THEN 'аудио/' ELSE '' END || split_part(path, '/', 1) || '/' AS tail, split_part(path, '/', 3) AS name FROM w),
b AS (SELECT *, CASE why WHEN 'copy' THEN 'ПРОЧЕЕ/_дубликаты/' || replace(path, '/', '__') WHEN 'junk' THEN 'ПРОЧЕЕ/_мусор/' || replace(path, '/', '__') WHEN 'other' THEN name WHEN 'unknown' THEN 'ПРОЧЕЕ/' || tail || name
  WHEN 'partial-season' THEN y || '/' || CASE season WHEN 'лето' THEN 'Лето/' ELSE 'Осень/' END || tail || name WHEN 'dated' THEN y || '/' ||
  CASE WHEN month(d) <= 2 THEN 'Зима начало года/' WHEN month(d) <= 5 THEN 'Весна/' WHEN month(d) <= 8 THEN 'Лето/' WHEN month(d) <= 11 THEN 'Осень/' ELSE 'Зима конец года/' END || tail || name
  ELSE y || '/прочее/' || tail || name END AS target,
  CASE WHEN why = 'assumed' THEN 'assumed-year' WHEN why = 'partial-year' AND season IS NOT NULL THEN 'ambiguous-season' END AS issue FROM t)"""


def _bucketed(spark, sf_dir):
    """Orders as assets of all kinds and statuses, dated by their order date."""
    k, none = F.col("o_orderkey"), F.lit(None)
    status = F.when(k % 5 == 0, "unknown").when(k % 5 == 1, "partial").otherwise("dated")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), F.concat(F.lit("Trip "), (k % 3).cast("string"), F.lit("/2001/f"), k.cast("string"), F.lit(".x")).alias("path"), F.when(k % 11 == 0, "junk").when(k % 11 == 1, "other").when(k % 11 == 2, "video").when(k % 11 == 3, "audio").otherwise("photo").alias("kind"),
        (k % 13 == 5).alias("is_copy"), status.alias("status"), (k % 10 == 1).alias("assumed"), F.when(k % 4 == 0, "лето").when(k % 4 == 1, "зима").when(k % 4 == 2, "осень").otherwise(none).alias("season"),
        F.year("o_orderdate").alias("year"), dates.format_wall(dates.wall_of_instant(F.col("o_orderdate")).cast(WALL)).alias("date"), none.cast("timestamp").alias("instant"),
    )
    return buckets.bucketed(rows)


@query(_BUCKET_SQL + " SELECT k AS o_orderkey, why, target, issue FROM b")
def target_path(spark, sf_dir):
    """The destination of each order's file and what is disputable about it."""
    return _bucketed(spark, sf_dir).select(F.col("k").alias("o_orderkey"), "why", buckets.target().alias("target"), "issue")


@query(_BUCKET_SQL + " SELECT why, lower(target) = lower(replace(CASE WHEN k % 2 = 0 THEN upper(target) ELSE path END, '/', '/')) AS in_place, count(*) AS n FROM b WHERE why <> 'other' GROUP BY 1, 2")
def noop_split(spark, sf_dir):
    """Moves whose target is where the file already is, case aside (every second file is put there)."""
    rows = _bucketed(spark, sf_dir).filter("why <> 'other'").withColumn("target", buckets.target())
    there = F.when(F.col("k") % 2 == 0, F.upper("target")).otherwise(F.col("path"))
    return rows.groupBy("why", paths.same_path(there, F.col("target")).alias("in_place")).agg(F.count("*").alias("n"))


@query(_BUCKET_SQL + """
, c AS (SELECT count(*) FILTER (WHERE why <> 'other') AS moves, count(*) FILTER (WHERE why = 'other') AS stays, count(*) FILTER (WHERE issue IS NOT NULL) AS disputed, count(DISTINCT target) FILTER (WHERE why <> 'other') AS targets FROM b)
SELECT unnest(['moves', 'stays', 'disputed', 'targets']) AS what, unnest([moves, stays, disputed, targets]) AS n FROM c
""")
def plan_counts(spark, sf_dir):
    """The scalars of a plan as rows."""
    rows = _bucketed(spark, sf_dir).withColumn("target", buckets.target())
    moving = F.col("action") == "move"
    one = rows.agg(F.count_if(moving).alias("moves"), F.count_if(~moving).alias("stays"), F.count_if(F.col("issue").isNotNull()).alias("disputed"), F.count_distinct(F.when(moving, F.col("target"))).alias("targets"))
    return one.select(F.explode(F.create_map(*[x for c in one.columns for x in (F.lit(c), F.col(c))])).alias("what", "n"))


@query(_BUCKET_SQL + " SELECT issue, why, count(*) AS n FROM b WHERE issue IS NOT NULL GROUP BY 1, 2")
def disputed_report(spark, sf_dir):
    """Disputable destinations by issue and reason."""
    return _bucketed(spark, sf_dir).filter("issue IS NOT NULL").groupBy("issue", "why").agg(F.count("*").alias("n"))


_PAGES_SQL = """
WITH a AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'misc/' WHEN 1 THEN 'Camera/Разное/' WHEN 2 THEN 'good/' WHEN 3 THEN 'Скриншоты/misc/' WHEN 4 THEN '12345/tmp/' ELSE '' END || CASE WHEN page_id % 4 = 0 THEN 'deep/' ELSE '' END || 'p' || page_id || '.x' AS path,
  CASE WHEN page_id % 9 = 0 THEN 'other' ELSE 'photo' END AS kind, CASE WHEN page_id % 6 = 4 THEN '2001' ELSE (2000 + page_id % 5)::VARCHAR END || '/x' AS place FROM pages),
s AS (SELECT page_id, path, place, CASE page_id % 6 WHEN 0 THEN 'misc' WHEN 1 THEN 'Camera/Разное' WHEN 3 THEN 'Скриншоты' WHEN 4 THEN '12345/tmp' END AS dir,
  CASE page_id % 6 WHEN 3 THEN 'device' ELSE 'placeholder' END AS reason FROM a WHERE kind <> 'other' AND page_id % 6 IN (0, 1, 3, 4))"""


def _page_assets(spark, sf_dir):
    """Pages as files in directories with names that say nothing."""
    k = F.col("page_id")
    top = F.when(k % 6 == 0, "misc/").when(k % 6 == 1, "Camera/Разное/").when(k % 6 == 2, "good/").when(k % 6 == 3, "Скриншоты/misc/").when(k % 6 == 4, "12345/tmp/").otherwise("")
    path = F.concat(top, F.when(k % 4 == 0, "deep/").otherwise(""), F.lit("p"), k.cast("string"), F.lit(".x"))
    year = F.when(k % 6 == 4, F.lit("2001")).otherwise((k % 5 + 2000).cast("string"))
    return table(spark, sf_dir, "pages").select(path.alias("path"), F.when(k % 9 == 0, "other").otherwise("photo").alias("kind"), F.lit("move").alias("action"), F.array(year, F.lit("x")).alias("segments"), k.alias("page_id"))


@query(_PAGES_SQL + " SELECT dir, reason, count(*) AS files FROM s GROUP BY 1, 2 HAVING count(DISTINCT place) > 1")
def suspicious_dirs(spark, sf_dir):
    """Directories that need a decision and whose files would be scattered."""
    assets = _page_assets(spark, sf_dir)
    return plan.scattered(plan.suspicious_of(assets), assets)


@query(_PAGES_SQL + ", h AS (SELECT dir FROM s GROUP BY dir HAVING count(DISTINCT place) > 1) SELECT dir, count(*) AS n FROM h JOIN a ON a.path LIKE h.dir || '/%' GROUP BY dir")
def held_by(spark, sf_dir):
    """Files under a held directory, by directory."""
    assets = _page_assets(spark, sf_dir)
    held = plan.scattered(plan.suspicious_of(assets), assets)
    return plan.held_by(assets, held).groupBy("dir").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT 'f' || lpad(p_partkey::VARCHAR, 9, '0') AS source, p_brand || '/' || p_size || '.jpg' AS target FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY source) AS n FROM c)
SELECT source, target, CASE WHEN n = 1 THEN target ELSE replace(target, '.jpg', ' (' || n || ').jpg') END AS final FROM r
""")
def collisions(spark, sf_dir):
    """Parts of one brand and size claim one name; later ones are numbered."""
    k = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    moves = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), k).alias("source"), F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit(".jpg")).alias("target"))
    return plan.collisions(moves, "source", "target")


@query("""
WITH c AS (SELECT 'f' || lpad(p_partkey::VARCHAR, 9, '0') AS source, p_brand || '/' || p_size % 5 AS root, CASE p_partkey % 3 WHEN 0 THEN 1 + p_partkey % 41 END AS asked, CASE WHEN p_size % 2 = 0 THEN '.jpg' ELSE '' END AS ext FROM part),
n AS (SELECT source, root, ext, CASE WHEN asked > 1 THEN asked END AS k, root || CASE WHEN asked > 1 THEN ' (' || asked || ')' ELSE '' END AS stem FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY stem, ext ORDER BY source) - 1 AS place FROM n),
t AS (SELECT root, ext, count(*) FILTER (WHERE k IS NULL) AS claimants, list(DISTINCT k) FILTER (WHERE k IS NOT NULL) AS taken FROM n GROUP BY root, ext),
f AS (SELECT r.*, CASE
    WHEN k IS NOT NULL THEN CASE WHEN r.ext = '' AND k <= claimants THEN place + 2 WHEN place > 0 THEN place + 1 END
    WHEN place > 0 THEN CASE WHEN r.ext = '' THEN place + 1 ELSE list_filter(range(2, claimants + 50), lambda x: NOT list_contains(coalesce(taken, []), x))[place] END
  END AS number FROM r JOIN t ON r.root = t.root AND r.ext = t.ext)
SELECT source, stem || ext AS target, stem || CASE WHEN number IS NULL THEN '' ELSE ' (' || number || ')' END || ext AS final FROM f
""")
def collision_gaps(spark, sf_dir):
    """Names asked for with and without numbers and extensions: the first free number is a gap between those that others ask for."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    asked = F.when(k % 3 == 0, 1 + k % 41)
    stem = F.concat("p_brand", F.lit("/"), (F.col("p_size") % 5).cast("string"), F.when(asked > 1, F.concat(F.lit(" ("), asked.cast("string"), F.lit(")"))).otherwise(""))
    moves = part.select(F.concat(F.lit("f"), F.lpad(k.cast("string"), 9, "0")).alias("source"), F.concat(stem, F.when(F.col("p_size") % 2 == 0, ".jpg").otherwise("")).alias("target"))
    return plan.collisions(moves, "source", "target")


@query("""
WITH p AS (SELECT 'd' || (page_id % 50) || '/e' || (page_id % 7) || '/f' || page_id % 200 AS dir, page_id FROM pages),
dirs AS (SELECT dir FROM p UNION SELECT split_part(dir, '/', 1) FROM p UNION SELECT split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2) FROM p),
kept AS (SELECT DISTINCT upper(split_part(dir, '/', 1)) || '/' || split_part(dir, '/', 2) AS dir FROM p WHERE page_id % 50 < 20 AND page_id % 3 = 0)
SELECT dir, len(string_split(dir, '/')) AS level FROM dirs d WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE lower(k.dir) = lower(d.dir) OR lower(k.dir) LIKE lower(d.dir) || '/%')
""")
def emptied_dirs(spark, sf_dir):
    """Directories under which nothing stays."""
    k = F.col("page_id")
    part = lambda name, n: F.concat(F.lit(name), (k % n).cast("string"))
    files = table(spark, sf_dir, "pages").select(k, F.concat_ws("/", part("d", 50), part("e", 7), part("f", 200), F.lit("x.jpg")).alias("path"))
    dirs = files.select(F.explode(paths.ancestors(F.col("path"))).alias("dir")).distinct()
    stay = files.filter("page_id % 50 < 20 AND page_id % 3 = 0").select(F.concat_ws("/", F.upper(part("d", 50)), part("e", 7), F.lit("x.jpg")).alias("path"))
    return plan.emptied_dirs(dirs, stay).withColumn("level", F.col("level").cast("long"))


_JOURNAL_SQL = """
WITH j AS (SELECT 'r' || user_id AS run_id, event_id AS seq, ts, CASE event_id % 5 WHEN 0 THEN 'planned-move' WHEN 1 THEN 'moved' WHEN 2 THEN 'planned-move' WHEN 3 THEN 'error' ELSE CASE WHEN user_id % 3 = 0 AND event_id % 10 = 4 THEN 'done' ELSE 'mkdir' END END AS kind,
  'a' || (event_id % 40) AS src, 'b' || (event_id % 40 // 4) AS dst, user_id % 7 = 0 AS dry FROM events)"""


def _records(spark, sf_dir):
    """Events as journal records: the user is the run."""
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.when(e % 5 == 0, "planned-move").when(e % 5 == 1, "moved").when(e % 5 == 2, "planned-move").when(e % 5 == 3, "error").when((u % 3 == 0) & (e % 10 == 4), "done").otherwise("mkdir")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), u.cast("string")).alias("run_id"), e.alias("seq"), "ts", kind.alias("kind"), F.concat(F.lit("a"), (e % 40).cast("string")).alias("from"),
        F.concat(F.lit("b"), F.floor(e % 40 / 4).cast("string")).alias("to"), F.lit("").alias("dir"), (u % 7 == 0).alias("dry_run"),
    )


@query(_JOURNAL_SQL + """, r AS (SELECT run_id, bool_or(kind = 'done') AS finished, bool_or(dry) AS dry_run, count(*) FILTER (WHERE kind = 'planned-move') AS planned, count(*) FILTER (WHERE kind = 'moved') AS moved, max(seq) AS last_seq FROM j GROUP BY run_id)
SELECT *, run_id LIKE '%2' OR run_id LIKE '%3' AS has_backup, NOT dry_run AND finished AND (run_id LIKE '%2' OR run_id LIKE '%3') AS undoable FROM r""")
def run_history(spark, sf_dir):
    """What each run did and whether it can be undone; runs ending in 2 or 3 have a backup."""
    records = _records(spark, sf_dir)
    backed = records.select("run_id").filter("run_id LIKE '%2' OR run_id LIKE '%3'")
    return journal.run_history(records, backed).drop("started_at")


@query(_JOURNAL_SQL + " SELECT run_id, count(*) FILTER (WHERE kind = 'planned-move') AS planned, count(*) FILTER (WHERE kind = 'moved') AS moved, max(seq) AS last_seq FROM j GROUP BY run_id HAVING NOT bool_or(kind = 'done') AND NOT bool_or(dry)")
def unfinished_runs(spark, sf_dir):
    """Real runs without an end."""
    return journal.unfinished_runs(_records(spark, sf_dir)).drop("started_at")


@query(_JOURNAL_SQL + " SELECT run_id, seq, src, dst FROM j p WHERE kind = 'planned-move' AND NOT EXISTS (SELECT 1 FROM j m WHERE m.kind = 'moved' AND m.run_id = p.run_id AND m.src = p.src AND m.dst = p.dst)")
def unconfirmed_moves(spark, sf_dir):
    """Planned moves that no record confirms."""
    return journal.unconfirmed_moves(_records(spark, sf_dir)).select("run_id", "seq", F.col("from").alias("src"), F.col("to").alias("dst"))


@query(_JOURNAL_SQL + """, u AS (SELECT run_id, seq, true AS confirmed FROM j WHERE kind = 'moved' UNION ALL SELECT run_id, seq, false FROM j p WHERE kind = 'planned-move' AND NOT EXISTS (SELECT 1 FROM j m WHERE m.kind = 'moved' AND m.run_id = p.run_id AND m.src = p.src AND m.dst = p.dst))
SELECT run_id, seq, confirmed, row_number() OVER (PARTITION BY run_id ORDER BY confirmed DESC, seq DESC) AS step FROM u""")
def rollback_order(spark, sf_dir):
    """The order in which each run's moves are undone."""
    from pyspark.sql import Window

    rows = journal.rollback_order(_records(spark, sf_dir)).select("run_id", "seq", "confirmed")
    return rows.withColumn("step", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("confirmed"), F.desc("seq"))).cast("long"))


_CACHE_SQL = """
WITH now AS (SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS path, l_quantity::BIGINT AS size, epoch_ms(l_shipdate)::DOUBLE AS mtime_ms FROM lineitem),
now1 AS (SELECT DISTINCT * FROM now QUALIFY row_number() OVER (PARTITION BY path ORDER BY size, mtime_ms) = 1),
old AS (SELECT path, size + CASE WHEN size % 5 = 0 THEN 1 ELSE 0 END AS size, mtime_ms, 'photo' AS kind FROM now1 WHERE size % 3 > 0)"""


def _snapshots(spark, sf_dir):
    """Line items as a listing, and an older snapshot of it with some sizes changed and some files missing."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_quantity").cast("long").alias("size"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).cast("double").alias("mtime_ms"))
    listing = rows.groupBy("path").agg(F.min(F.struct("size", "mtime_ms")).alias("m")).select("path", "m.size", "m.mtime_ms")
    old = listing.filter("size % 3 > 0").select("path", (F.col("size") + F.when(F.col("size") % 5 == 0, 1).otherwise(0)).alias("size"), "mtime_ms", F.lit("photo").alias("kind"), F.lit("jpeg").alias("format"), F.sha2("path", 256).alias("sha256"))
    return listing, old


@query(_CACHE_SQL + " SELECT count(*) FILTER (WHERE o.kind IS NOT NULL) AS hits, count(*) FILTER (WHERE o.kind IS NULL) AS misses FROM now1 n LEFT JOIN old o ON n.path = o.path AND n.size = o.size AND n.mtime_ms = o.mtime_ms")
def cache_probe(spark, sf_dir):
    """Files whose path, size and time are those of the cached scan."""
    listing, old = _snapshots(spark, sf_dir)
    return cache.probe(listing, old).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query(_CACHE_SQL + " SELECT CASE WHEN size % 7 = 0 THEN 'moved/' || path ELSE path END AS path, size FROM old")
def cache_rekey(spark, sf_dir):
    """K2: the cached scan after some files were moved."""
    _, old = _snapshots(spark, sf_dir)
    moves = old.filter("size % 7 = 0").select(F.col("path").alias("from"), F.concat(F.lit("moved/"), "path").alias("to"))
    return cache.rekey(old, moves).select("path", "size")


_FILES_SQL = """
WITH old AS (SELECT 'd' || o_custkey % 40 || '/e' || o_custkey % 7 || '/o' || o_orderkey AS path, o_orderkey AS k, 100 + o_orderkey % 9 AS size, md5((o_orderkey % 5000)::VARCHAR) AS sha256 FROM orders WHERE o_orderkey % 19 > 0),
new AS (
  SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'moved/' || o_custkey % 3 || '/' ELSE 'd' || o_custkey % 40 || '/e' || o_custkey % 7 || '/' END || 'o' || o_orderkey AS path, o_orderkey AS k,
         CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 100 + o_orderkey % 9 END AS size, md5((CASE WHEN o_orderkey % 17 = 0 THEN -o_orderkey ELSE o_orderkey % 5000 END)::VARCHAR) AS sha256
  FROM orders WHERE o_orderkey % 11 > 0)"""


def _scans(spark, sf_dir):
    """Orders as the files of two scans: a nineteenth comes, an eleventh goes, a thirteenth moves, a seventeenth changes; contents repeat."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    home = F.concat(F.lit("d"), (F.col("o_custkey") % 40).cast("string"), F.lit("/e"), (F.col("o_custkey") % 7).cast("string"), F.lit("/"))
    name = F.concat(F.lit("o"), k.cast("string"))
    said = lambda x: F.md5(x.cast("string"))
    facts = [F.lit(5.0).alias("mtime_ms"), F.lit("photo").alias("kind"), F.lit("jpeg").alias("format")]
    old = orders.filter(k % 19 > 0).select(F.concat(home, name).alias("path"), (100 + k % 9).alias("size"), *facts, said(k % 5000).alias("sha256"))
    other = F.when(k % 13 == 0, F.concat(F.lit("moved/"), (F.col("o_custkey") % 3).cast("string"), F.lit("/"))).otherwise(home)
    new = orders.filter(k % 11 > 0).select(F.concat(other, name).alias("path"), F.when(k % 17 == 0, 1).otherwise(100 + k % 9).cast("long").alias("size"), *facts, said(F.when(k % 17 == 0, -k).otherwise(k % 5000)).alias("sha256"))
    return old, new


@query(_FILES_SQL + """
, gone AS (SELECT *, row_number() OVER (PARTITION BY sha256, size ORDER BY path) AS n FROM old WHERE path NOT IN (SELECT path FROM new)),
added AS (SELECT *, row_number() OVER (PARTITION BY sha256, size ORDER BY path) AS n FROM new WHERE path NOT IN (SELECT path FROM old)),
pairs AS (SELECT a.path, g.path AS was FROM added a JOIN gone g ON a.sha256 = g.sha256 AND a.size = g.size AND a.n = g.n)
SELECT path, 'moved' AS change, was FROM pairs UNION ALL SELECT path, 'added', NULL FROM added WHERE path NOT IN (SELECT path FROM pairs)
UNION ALL SELECT path, 'gone', NULL FROM gone WHERE path NOT IN (SELECT was FROM pairs)
UNION ALL SELECT o.path, 'changed', NULL FROM old o JOIN new n ON o.path = n.path WHERE o.size <> n.size OR o.sha256 <> n.sha256
""")
def scan_changes(spark, sf_dir):
    """The difference of two scans; equal contents that went and came are moves, in the order of their paths."""
    return changes.changes(*_scans(spark, sf_dir))


@query(_FILES_SQL + """
, f AS (SELECT *, string_split(path, '/') AS parts FROM new), up AS (SELECT array_to_string(parts[1:i], '/') AS dir, size FROM f, unnest(range(0, len(parts))) t(i))
SELECT dir, count(*) AS files, sum(size)::BIGINT AS bytes FROM up GROUP BY dir
""")
def dir_totals(spark, sf_dir):
    """Files and bytes below every directory, rolled up level by level."""
    _, new = _scans(spark, sf_dir)
    return conservation.fingerprints(new).select("dir", "files", "bytes")


@query(_FILES_SQL + """
SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'lost' WHEN o.path IS NULL THEN 'new' ELSE 'changed' END AS what
FROM old o FULL JOIN new n ON o.path = n.path WHERE n.path IS NULL OR o.path IS NULL OR o.size <> n.size OR o.sha256 <> n.sha256
""")
def not_conserved(spark, sf_dir):
    """The files of directories whose fingerprints differ that aren't as they were."""
    return conservation.not_conserved(*_scans(spark, sf_dir))


@query(r"""
WITH p AS (SELECT p_partkey AS k, ['C:\\', '\\\\srv\\', '\\\\?\\C:\\', 'rel\\'][p_partkey % 4 + 1] AS root, repeat('abcdefghi' || CASE WHEN p_size % 2 = 0 THEN '\\' ELSE '/' END, 20 + p_size % 12) AS dirs, 'f' || p_partkey || '.jpg' AS name FROM part),
a AS (SELECT k, root || dirs || CASE WHEN k % 3 = 0 THEN '.\\x\\..\\' ELSE '' END || name AS path, replace(dirs, '/', '\\') || name AS body FROM p)
SELECT k AS p_partkey, CASE WHEN length(path) < 260 OR k % 4 > 1 THEN path WHEN k % 4 = 0 THEN '\\\\?\\C:\\' || body ELSE '\\\\?\\UNC\\srv\\' || body END AS extended,
  CASE WHEN k % 4 = 2 THEN substr(path, 5) ELSE path END AS plain FROM a
""".replace("\\\\", "\\"))
def long_paths(spark, sf_dir):
    """absolute paths of 260 characters or more get the prefix, settled before; others stay."""
    k, size = F.col("p_partkey"), F.col("p_size")
    root = F.element_at(F.array(*map(F.lit, ("C:\\", "\\\\srv\\", "\\\\?\\C:\\", "rel\\"))), (k % 4 + 1).cast("int"))
    dirs = F.expr("repeat(CASE WHEN p_size % 2 = 0 THEN 'abcdefghi|' ELSE 'abcdefghi/' END, 20 + p_size % 12)")
    path = F.concat(root, F.translate(dirs, "|", "\\"), F.when(k % 3 == 0, ".\\x\\..\\").otherwise(""), F.lit("f"), k.cast("string"), F.lit(".jpg"))
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return rows.select("p_partkey", paths.extended_form(F.col("path")).alias("extended"), paths.plain_form(F.col("path")).alias("plain"))
