"""Saved replays: a folder for each slug with a replay and, beside it, notes, overlays and records of publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import joins

#: Names of a folder's files.
REPLAY, NOTES, OVERLAYS = "replay.json", "annotations.json", "overlays.json"
META = "sessionId string, title string, provider string, model string, project string, startTime string, endTime string, stats string, generator struct<version:string>"
SCENES = "array<struct<type:string,content:string>>"
GIST = "gistId string, filename string, viewerUrl string, updatedAt string, contentHash string"
CLOUD = "id string, url string, expiresAt string, updatedAt string"


def documents(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    """(slug, rank, json): the file ``name`` of every folder below each of the paths, ``rank`` being the path's place in the list.

    A file is one row, so it has to be below 2 GB.
    """
    out = None
    for rank, path in enumerate(paths):
        rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path, wholetext=True)
        rows = rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("slug"), F.lit(rank).alias("rank"), F.col("value").alias("json"))
        out = rows if out is None else out.unionByName(rows)
    return out.where(F.try_parse_json("json").isNotNull())


def _items(json):
    """A JSON array as its elements' texts; null for anything else."""
    return F.when(F.ltrim(json).startswith("["), F.from_json(json, "array<string>"))


def scan(spark: SparkSession, paths: list[str], gist_file: str, cloud_file: str, version: str | None = None) -> DataFrame:
    """A row for each slug, newest start first: what a replay says of its session, and what lies beside it.

    (slug, session, title, provider, model, project, start_time, end_time, stats, replay_size, generator_version,
    replay_outdated, annotation_count, messages, gist, cloud). Of a slug in several paths the first path's row counts. A
    replay is outdated if another version than ``version`` made it; ``gist.outdated`` tells that the replay changed since
    it was published. Replays that are no JSON or lack ``meta`` are left out; broken files beside one count as missing.
    """
    r = documents(spark, paths, REPLAY).withColumn("m", F.from_json(F.get_json_object("json", "$.meta"), META)).where("m is not null")
    prompts = F.transform(F.filter(F.from_json(F.get_json_object("json", "$.scenes"), SCENES), lambda s: s["type"] == "user-prompt"), lambda s: F.substring(text.clean_prompt(s["content"]), 1, 200))
    messages = F.slice(F.filter(prompts, lambda p: F.length(p) >= 10), 1, 2)
    made_by = F.nullif(F.col("m.generator.version"), F.lit(""))
    rows = r.select(
        "slug", "rank", F.col("m.sessionId").alias("session"), F.col("m.title").alias("title"), F.col("m.provider").alias("provider"), F.col("m.model").alias("model"), F.col("m.project").alias("project"),
        F.col("m.startTime").alias("start_time"), F.col("m.endTime").alias("end_time"), F.col("m.stats").alias("stats"), F.octet_length("json").alias("replay_size"), made_by.alias("generator_version"),
        F.coalesce(made_by != F.lit(version), F.lit(False)).alias("replay_outdated"), F.when(F.size(messages) > 0, messages).alias("messages"), F.substring(F.sha2("json", 256), 1, 16).alias("hash"),
    )
    notes = documents(spark, paths, NOTES).select("slug", "rank", F.coalesce(F.size(_items(F.col("json"))), F.lit(0)).alias("annotation_count"))
    gist = documents(spark, paths, gist_file).select("slug", "rank", F.from_json("json", GIST).alias("g")).where("g.gistId <> '' and g.filename <> ''")
    cloud = documents(spark, paths, cloud_file).select("slug", "rank", F.from_json("json", CLOUD).alias("cloud")).where("cloud.id <> '' and cloud.url <> ''")
    for beside in (notes, gist, cloud):
        rows = rows.join(beside, ["slug", "rank"], "left")
    changed = F.coalesce(F.col("g.contentHash") != F.col("hash"), F.lit(False))
    found = F.when(F.col("g").isNotNull(), F.struct(F.col("g.gistId").alias("id"), F.col("g.viewerUrl").alias("url"), F.col("g.updatedAt").alias("updated_at"), changed.alias("outdated")))
    rows = rows.withColumn("gist", found).withColumn("annotation_count", F.coalesce("annotation_count", F.lit(0))).drop("g", "hash")
    return joins.first_per_key(rows, ["slug"], ["rank"]).drop("rank").orderBy(F.desc_nulls_last("start_time"), "slug")


def load(spark: SparkSession, paths: list[str], slug: str) -> DataFrame:
    """(slug, replay, annotations): one replay as JSON with its notes, null if there are none; no row if no path has it."""
    one = documents(spark, paths, REPLAY).where(F.col("slug") == slug)
    notes = documents(spark, paths, NOTES).where(F.col("slug") == slug).select("slug", "rank", F.when(F.size(_items(F.col("json"))) > 0, F.col("json")).alias("annotations"))
    return joins.first_per_key(one.join(notes, ["slug", "rank"], "left"), ["slug"], ["rank"]).select("slug", F.col("json").alias("replay"), "annotations")


def annotations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(slug, position, annotation): every note as JSON, those of the first path that has a list for the slug."""
    lists = documents(spark, paths, NOTES).select("slug", "rank", _items(F.col("json")).alias("items")).where("items is not null")
    return joins.first_per_key(lists, ["slug"], ["rank"]).select("slug", F.posexplode("items").alias("position", "annotation"))


def overlays(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(slug, position, overlay), likewise."""
    lists = documents(spark, paths, OVERLAYS).select("slug", "rank", _items(F.get_json_object("json", "$.overlays")).alias("items")).where("items is not null")
    return joins.first_per_key(lists, ["slug"], ["rank"]).select("slug", F.posexplode("items").alias("position", "overlay"))


def archived(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(slug): the names of the marker files in each of the paths, none where a path is missing.

    Markers are empty, and Spark's readers skip empty files, so a task for each path lists it.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
                yield pa.RecordBatch.from_arrays([pa.array([f.base_name for f in found if f.type == fs.FileType.File], pa.string())], names=["slug"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInArrow(run, "slug string").distinct()


def to_regenerate(replays: DataFrame, sources: DataFrame) -> DataFrame:
    """Replays with the source of their session; those whose source is gone are left out."""
    return replays.join(sources, "session")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, data_uri): image files in base64, their type by name."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    plain = F.regexp_replace("path", r"^file:/+", "/")
    low = F.lower(plain)
    kind = F.when(low.rlike(r"\.jpe?g$"), "image/jpeg").when(low.endswith(".webp"), "image/webp").when(low.endswith(".gif"), "image/gif").otherwise("image/png")
    return listing.where(low.rlike(r"\.(?:png|jpe?g|gif|webp)$")).select(plain.alias("path"), F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64("content")).alias("data_uri"))
