"""File sources: job documents, lexicon, trajectories, timelines, manifest, media listing, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per job; unreadable documents are skipped."""
    raw = spark.read.schema(schemas.JOB).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return raw.where(F.col("_corrupt_record").isNull() & F.col("job_id").isNotNull()).drop("_corrupt_record")


def owned_jobs(jobs: DataFrame, owner_user_id: str | None = None, owner_username: str | None = None, include_unowned: bool = False) -> DataFrame:
    """Catalog of one owner, newest first: id match OR case-insensitive name match."""
    if owner_user_id is not None:
        uid = F.coalesce("owner_user_id", F.lit(""))
        name = F.lower(F.trim(F.coalesce("owner_username", F.lit(""))))
        mine = (uid != "") & (uid == owner_user_id)
        wanted = (owner_username or "").strip().lower()
        if wanted:
            mine = mine | (name == wanted)
        if include_unowned:
            mine = mine | (uid == "")
        jobs = jobs.where(mine)
    return jobs.orderBy(F.desc("created_at"), "job_id")


def child_rows(jobs: DataFrame, array: str, index: str) -> DataFrame:
    """Explode a nested array of the job documents into its own table."""
    return jobs.select("job_id", F.posexplode(array).alias(index, "r")).select("job_id", index, "r.*")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Trend phrases; entries without a phrase or with a bad number are skipped.
    A path that matches no file gives an empty table."""
    try:
        raw = spark.read.schema(schemas.LEXICON).option("multiLine", True).json(path)
    except Exception as e:  # the analysis error of a missing path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], schemas.LEXICON)
    return lexicon_rows(raw)


def lexicon_rows(raw: DataFrame) -> DataFrame:
    e = raw.select(F.explode("entries").alias("e")).select("e.*")
    hot = F.when(F.col("hotness").isNull(), 0.5).otherwise(F.expr("try_cast(hotness AS double)"))
    none = F.array().cast("array<string>")
    return e.select("phrase", F.coalesce("genres", none).alias("genres"), F.coalesce("platforms", none).alias("platforms"),
                    hot.alias("hotness")).where(F.col("phrase").isNotNull() & F.col("hotness").isNotNull())


def _slug() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.jsonl?$", 1)


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one file per clip; missing optional fields take defaults."""
    d = spark.read.schema(schemas.TRAJECTORY).json(path).withColumn("slug", _slug())
    return d.fillna({"n_subjects_in_crop": 1, "is_split_screen": False})


def read_timelines(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """Frame events per manifest clip; a clip with no, broken or empty file keeps one null row."""
    raw = spark.read.schema(schemas.TIMELINE).option("multiLine", True).json(path).withColumn("slug", _slug())
    events = raw.where(F.col("_corrupt_record").isNull()).select("slug", F.posexplode("events").alias("event_no", "e")).select("slug", "event_no", "e.*")
    return manifest.select("slug").join(events, "slug", "left")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)
    return raw.select(F.explode("clips").alias("c")).select("c.*")


# Media file extensions by type.
MEDIA_TYPES = {
    "video": ("mp4", "mov", "webm", "mkv"),
    "audio": ("mp3", "wav", "aac", "ogg", "flac"),
    "image": ("png", "jpg", "jpeg", "gif", "webp"),
}


def media_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, exts in MEDIA_TYPES.items():
        out = F.when(ext.isin(*exts), kind).otherwise(out)
    return out


def media_listing(files: DataFrame, names: DataFrame) -> DataFrame:
    """Typed media files of a listing (job_id, name, size) with their original names."""
    d = files.where(~F.col("name").startswith("_")).withColumn("type", media_type(F.col("name"))).where("type IS NOT NULL")
    d = d.withColumn("id", F.regexp_replace("name", r"\.[^.]*$", ""))
    d = d.join(names.select("job_id", F.col("media_id").alias("id"), "original_filename"), ["job_id", "id"], "left")
    return d.select("job_id", "id", F.coalesce("original_filename", "name").alias("filename"), "type", "size",
                    F.concat(F.lit("/api/files/"), F.col("job_id").cast("string"), F.lit("/media/"), "name").alias("url"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """File listing (job_id is the directory above ``media``); contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    return d.select(F.regexp_extract("path", r"/([^/]+)/media/[^/]+$", 1).alias("job_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "size")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``app.log`` and its rotations, oldest file first; ``pos`` orders within the file.

    Splits of one file keep their order through the block start of the scan.
    """
    d = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    age = F.coalesce(F.expr(r"try_cast(regexp_extract(file, '\\.(\\d+)$', 1) AS int)"), F.lit(0))
    return d.select(age.alias("age"), "at", F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line")).orderBy(F.desc("age"), "at", "pos")
