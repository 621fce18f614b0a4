"""The library's front: scan, annotate, plan, apply and roll back a tree of files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, paths
from tidemark.functions import values as V
from tidemark.functions.dates import WALL
from tidemark.operators import corpus, evidence, pairing, pixels, similarity, verdict
from tidemark.plans import executor
from tidemark.plans.plan import Plan, build_plan
from tidemark.sources import cache, changes, inventory, metadata, texts
from tidemark.sources.scratch import written


@dataclass
class Inventory:
    assets: DataFrame
    dirs: DataFrame
    errors: DataFrame


def scan(spark: SparkSession, root: str, cached: DataFrame | None = None) -> Inventory:
    return Inventory(*inventory.scan_tree(spark, root, cached))


def pixel_claims(root: str, assets: DataFrame, claims: DataFrame, verdicts: DataFrame, facts: DataFrame, models: DataFrame) -> DataFrame:
    """Claims of JPEG photos that an editor saved without a date: the capture date of the photo whose pixels they show.

    models: path, model of the query's camera as far as it is known. The tree has to be readable by Spark.
    """
    month = F.format_string("%04d-%02d", F.col("wall.year"), F.col("wall.month"))
    saved = claims.filter("kind = 'editor-save'").groupBy("path").agg(F.min(month).alias("latest"))
    queries = written(pairing.broken_class(assets, verdicts, saved).join(models.select("path", "model"), "path", "left"), "queries")
    taken = claims.filter("kind = 'exif-original'").groupBy("path").agg(F.min_by("wall", F.struct("source_ord", "seq")).alias("wall"))
    dated = verdicts.filter("status = 'dated'").select("path", F.substring("date", 1, 10).alias("day"))
    photos = assets.filter("kind = 'photo' AND format = 'jpeg'").select("path").join(taken.select("path"), "path").join(dated, "path").join(facts.select("path", "model"), "path", "left")
    pairs = written(pairing.nominate(queries, photos), "pairs")
    needed = pairs.select(F.col("query").alias("path")).unionByName(pairs.select(F.col("candidate").alias("path"))).distinct()
    decoded = pixels.images(assets.sparkSession, root).withColumn("path", pixels.below(F.col("origin"), root)).join(needed, "path", "left_semi")
    scored = written(pixels.score_previews(pairs, written(pixels.previewed(decoded), "previews")), "scores")
    compared = scored.groupBy("query").agg(F.count("*").alias("compared"))
    verified = scored.filter("fine IS NOT NULL").join(compared, "query")
    found = similarity.decide_by_margin(verified, "query", "candidate", "fine", "day").filter("decisive")
    found = found.select(F.col("query"), F.col("best").alias("path")).join(taken, "path").select(F.col("query").alias("path"), F.col("path").alias("original"), "wall")
    return evidence.exploded(found, F.array_compact(F.array(evidence.claim("pixel-original", F.col("wall"), detail=F.col("original")))), 13)


def own_claims(assets: DataFrame, now_year: int, raw: DataFrame | None = None) -> DataFrame:
    """The claims of names, directories, metadata and sidecars: what an asset and its directory say, and nothing else."""
    media = assets.filter(F.col("kind").isin(*V.MEDIA_KINDS))
    sources = []
    if raw is not None:
        own = raw.join(media.select("path"), "path", "left_semi")
        sources.append(evidence.exploded(own, metadata.photo_claims(own), 0))
        pairs = pairing.pair_sidecars(assets)
        beside = raw.withColumnRenamed("path", "sidecar").join(pairs, "sidecar")
        said, written_down = metadata.exif_wall(F.col("original")), metadata.sidecar_wall(F.col("xmp_original"))
        detail = F.concat(paths.base_of(F.col("sidecar")), F.lit(" (DateTimeOriginal)"))
        claims = F.array_compact(F.array(
            evidence.claim("sidecar", said, detail=detail),
            F.when(said.isNull(), evidence.claim("sidecar", written_down["wall"], date_only=F.coalesce(written_down["date_only"], F.lit(False)), detail=detail)),
        ))
        sources.append(evidence.exploded(beside, claims, 3))
    return evidence.collect(assets, now_year, *sources)


def spike_days(assets: DataFrame) -> DataFrame:
    media = assets.filter(F.col("kind").isin(*V.MEDIA_KINDS))
    return corpus.spike_days(media.withColumn("ts", F.timestamp_millis(F.col("mtime_ms").cast("long"))), "ts")


def annotate(assets: DataFrame, now_year: int, raw: DataFrame | None = None, root: str | None = None, world: World | None = None) -> DataFrame:
    """VERDICT rows of all media files. world: claims and statistics of the whole inventory where assets are a part of it.

    Four static passes: own claims; originals that a file derives from; inference from the directory (cohort)
    and from photos of the same camera (family); with root, originals found by their pixels. Evidence and verdicts
    are written, as every pass reads them again.
    """
    media = assets.filter(F.col("kind").isin(*V.MEDIA_KINDS))
    facts = None if raw is None else metadata.facts(raw)
    if world is None:
        claims = written(own_claims(assets, now_year, raw), "evidence")
        floor, spikes = corpus.floor_year(claims, now_year).first()["floor_year"], spike_days(assets)
    else:
        claims, floor, spikes = world.claims.join(media.select("path"), "path", "left_semi"), world.floor, world.spikes
    claims = evidence.union(claims, evidence.mtime_claims(media, spikes))
    if facts is not None:
        originals = claims.filter("kind = 'exif-original'").select("path", F.col("wall").alias("original_wall"))
        found = pairing.originals_of(facts, originals)
        inherited = F.array_compact(F.array(evidence.claim("derived-original", F.col("original_wall"), detail=F.col("original"))))
        claims = evidence.union(claims, evidence.exploded(found, inherited, 10))
    claims = written(claims, "evidence")
    first = written(verdict.resolve(claims, now_year, floor), "verdicts")
    unknown = first.filter("status = 'unknown'").select("path", paths.dir_of(F.col("path")).alias("dir"))
    cohort = unknown.join(corpus.cohorts(first).withColumnRenamed("year", "y"), "dir")
    year_claim = lambda kind, detail: F.array_compact(F.array(evidence.claim(kind, dates.wall(F.col("y"), F.lit(1), F.lit(1)).cast(WALL), date_only=True, detail=detail)))
    extra = [evidence.exploded(cohort, year_claim("dir-cohort", F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("total").cast("string"))), 12)]
    if facts is not None:
        census = corpus.camera_census(first, facts)
        saved = claims.filter("kind = 'editor-save'").select("path", F.col("wall.year").alias("latest"))
        own_year = F.when(verdict.is_confident() & F.col("model").isNotNull(), F.col("year")).alias("own_year")
        queries = first.filter("status <> 'dated'").select("path", "year", "winner", "confidence").join(saved, "path").join(facts.select("path", "model", "width", "height"), "path").withColumn("dir", paths.dir_of(F.col("path")))
        matched = pairing.family_match(queries.select("path", "dir", "model", "width", "height", own_year), census).join(queries.select("path", "latest"), "path")
        sure = matched.filter("first_year = last_year AND first_year <= latest").withColumn("y", F.col("first_year")).join(unknown.select("path"), "path", "left_semi")
        extra.append(evidence.exploded(sure, year_claim("family", F.concat_ws(" ", F.col("neighbours").cast("string"), "model")), 11))
    if facts is None or root is None:
        return written(verdict.resolve(evidence.union(claims, *extra), now_year, floor), "verdicts")
    claims = written(evidence.union(claims, *extra), "evidence")
    second = written(verdict.resolve(claims, now_year, floor), "verdicts")
    found = pixel_claims(root, assets, claims, second, facts, matched.select("path", "model"))
    return written(verdict.resolve(evidence.union(claims, found), now_year, floor), "verdicts")


@dataclass
class World:
    """What verdicts rest on beside an asset's own directory: all own claims, the floor year, the days of bulk copies."""

    claims: DataFrame
    floor: int | None
    spikes: DataFrame


@dataclass
class State:
    """A dated inventory that can be brought up to date: assets, their metadata, the world and the verdicts (all written tables)."""

    assets: DataFrame
    raw: DataFrame
    world: World
    verdicts: DataFrame
    now_year: int


def first_state(assets: DataFrame, raw: DataFrame, now_year: int) -> State:
    """The state of a whole inventory."""
    assets, raw = written(assets, "state-assets"), written(raw, "state-raw")
    claims = written(own_claims(assets, now_year, raw), "state-claims")
    world = World(claims, corpus.floor_year(claims, now_year).first()["floor_year"], written(spike_days(assets), "state-spikes"))
    return State(assets, raw, world, annotate(assets, now_year, raw, world=world), now_year)


def update(state: State, assets: DataFrame, read: Callable[[DataFrame], DataFrame]) -> tuple[State, DataFrame]:
    """(the state for a new scan, the directories whose verdicts were made anew), equal to first_state of the new scan.

    read gives the metadata of the assets that it is asked for: those added and changed; moved files keep theirs. Verdicts are
    made anew in the directories that a change lies in, where files derive from a document that a change concerns, and where
    a day became or ceased to be one of bulk copies; everywhere, without reading a file, if the floor year changed.
    Originals found by pixels aren't part of a state.
    """
    assets = written(assets, "state-assets")
    diff = written(changes.changes(state.assets, assets), "changes")
    touched = diff.select("path").unionByName(diff.filter("was IS NOT NULL").select(F.col("was").alias("path"))).distinct()
    fresh = assets.join(diff.filter("change IN ('added', 'changed')").select("path"), "path", "left_semi")
    went = diff.filter("change = 'moved'").select(F.col("was").alias("path"), F.col("path").alias("to"))
    kept = state.raw.join(touched, "path", "left_anti")
    carried = state.raw.join(went, "path").withColumn("path", F.col("to")).drop("to")
    raw = written(kept.unionByName(carried).unionByName(read(fresh)), "state-raw")

    dir_of = lambda df: df.select(paths.dir_of(F.col("path")).alias("dir"))
    spikes = written(spike_days(assets), "state-spikes")
    days = spikes.select("day").exceptAll(state.world.spikes.select("day")).unionByName(state.world.spikes.select("day").exceptAll(spikes.select("day")))
    copied = assets.withColumn("day", F.to_date(F.timestamp_millis(F.col("mtime_ms").cast("long")))).join(days, "day", "left_semi")
    documents = state.raw.unionByName(raw).join(touched, "path", "left_semi").select("document_id").filter("document_id IS NOT NULL").distinct()
    derived = raw.join(documents.withColumnRenamed("document_id", "derived_from"), "derived_from", "left_semi")
    dirs = written(dir_of(touched).unionByName(dir_of(copied)).unionByName(dir_of(derived)).distinct(), "touched-dirs")

    here = lambda df: df.join(dirs, paths.dir_of(df["path"]) == dirs["dir"], "left_semi")
    elsewhere = lambda df: df.join(dirs, paths.dir_of(df["path"]) == dirs["dir"], "left_anti")
    claims = written(elsewhere(state.world.claims).unionByName(own_claims(here(assets), state.now_year, here(raw))), "state-claims")
    world = World(claims, corpus.floor_year(claims, state.now_year).first()["floor_year"], spikes)
    if world.floor != state.world.floor:
        verdicts = annotate(assets, state.now_year, raw, world=world)
        dirs = written(dir_of(assets).distinct(), "touched-dirs")
    else:
        # The directories whole, and the files elsewhere whose documents theirs derive from: those speak, but keep their verdicts.
        wanted = here(raw).filter("derived_from IS NOT NULL").select(F.col("derived_from").alias("document_id")).distinct()
        speakers = raw.join(wanted, "document_id", "left_semi").select("path")
        part = written(here(assets).unionByName(elsewhere(assets).join(speakers, "path", "left_semi")), "part")
        made = annotate(part, state.now_year, raw.join(part.select("path"), "path", "left_semi"), world=world)
        verdicts = written(elsewhere(state.verdicts).unionByName(here(made)), "state-verdicts")
    return State(assets, raw, world, verdicts, state.now_year), dirs


def make_plan(found: Inventory, verdicts: DataFrame, decisions: DataFrame | None = None) -> Plan:
    return build_plan(found.assets, verdicts, found.dirs, decisions)


def apply(root: str, plan: Plan, dry_run: bool = False, backup: bool = True, run_id: str | None = None, found: Inventory | None = None) -> dict:
    """Carry a plan out; with the inventory all of it is backed up, and the scan cache follows the moves."""
    done = executor.apply_plan(root, plan.operations, plan.emptied, dry_run, backup, run_id, files=found and found.assets, dirs=found and found.dirs)
    if not dry_run and done["moved"]:
        records = texts.read_journals(plan.operations.sparkSession, f"{root}/{V.RUNS_DIR}/{done['run_id']}/journal.jsonl")
        cache.kept_after(plan.operations.sparkSession, root, records.filter("kind = 'moved'").select("from", "to"))
    return done


def roll_back(root: str, run_id: str, dry_run: bool = False) -> dict:
    return executor.roll_back(root, run_id, dry_run)
