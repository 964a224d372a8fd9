"""A1-A3: folder trees of JSON and text as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serialake import schemas
from serialake.functions import text
from serialake.operators.ordering import keep_first

_KEY = r"^[A-Za-z_]+="  # a partition folder ``name=value`` counts as ``value``


def _segment(path: Column, from_end: int) -> Column:
    """Path segment counted from the end, percent-decoded."""
    return F.url_decode(F.replace(F.regexp_replace(F.element_at(F.split(path, "/"), -from_end), _KEY, ""), F.lit("+"), F.lit("%2B")))


def read_works(spark: SparkSession, in_progress: str, completed: str, *, file_glob: str = "metadata.json") -> DataFrame:
    """A1: one work per folder of two roots: ``in_progress/<slug>`` and ``completed/<genre>/<slug>``.

    Unreadable files give no row. The genre is the folder for completed works, else the first
    category, else ``Unknown``. The same folder name in both roots counts once, as completed.
    """
    def scan(root: str) -> DataFrame:
        files = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file_glob).text(root, wholetext=True)
                 .select("value", F.col("_metadata.file_path").alias("path")))
        return _readable_objects(files, schemas.WORK).withColumn("slug", _segment(F.col("path"), 2))

    done = scan(completed).withColumn("genre", _segment(F.col("path"), 3)).withColumn("state", F.lit("completed"))
    first_category = F.try_element_at("categories", F.lit(1)).getField("name")
    running = scan(in_progress).withColumn("genre", F.coalesce(F.nullif(first_category, F.lit("")), F.lit("Unknown"))).withColumn("state", F.lit("ongoing"))
    return done.unionByName(running.join(done.select("slug"), "slug", "left_anti").select(done.columns))


def _readable_objects(files: DataFrame, schema: str) -> DataFrame:
    """Whole files to typed rows; a file that is not one JSON object gives none."""
    parsed = files.withColumn("o", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    others = [c for c in files.columns if c != "value"]
    return parsed.where("o is not null and o._corrupt is null").select(*others, "o.*").drop("_corrupt")


def read_parts(spark: SparkSession, root: str, *, file_glob: str = "*.txt", pattern: str = r"([^/]+)/([^/]+\.txt)$") -> DataFrame:
    """A2: stored parts: (work, file, index, title, size_bytes, text).

    ``pattern`` finds folder and file name in the path. The number is the leading digits of the name,
    else the place in name order is left to the caller (null); the title has its number removed.
    Spark's file sources never list empty files, so an empty part counts as not stored.
    """
    # The binary source reads contents only when the query asks for them.
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", file_glob).load(root)
             .select(F.decode("content", "UTF-8").alias("value"), "path", F.col("length").alias("size_bytes")))
    name = F.url_decode(F.replace(F.regexp_extract("path", pattern, 2), F.lit("+"), F.lit("%2B")))
    stem = F.regexp_replace(name, r"\.txt$", "")
    raw_title = F.coalesce(F.nullif(F.regexp_extract(stem, r"^[0-9]{4}[_.](.*)$", 1), F.lit("")), stem)
    return files.select(
        F.url_decode(F.replace(F.regexp_extract("path", pattern, 1), F.lit("+"), F.lit("%2B"))).alias("work"), name.alias("file"),
        F.regexp_extract(name, r"^([0-9]+)", 1).try_cast("bigint").alias("index"), text.strip_part_number(raw_title).alias("title"),
        "size_bytes", F.col("value").alias("text"))


def owned_state(states: DataFrame, *, site_key: str | Column, owner: str = "site_key") -> DataFrame:
    """A3: a state that names another owner is ignored; one without an owner belongs to whoever reads it."""
    wanted = F.lit(site_key) if isinstance(site_key, str) else site_key
    return states.where(F.coalesce(F.col(owner), wanted) == wanted)


def read_state(spark: SparkSession, path: str, *, site_key: str) -> DataFrame:
    """A3: crawl state of a site; a missing or unreadable file is an empty table."""
    if not _existing(spark, path):
        return spark.createDataFrame([], schemas.STATE)
    return owned_state(_readable_objects(spark.read.text(path, wholetext=True), schemas.STATE), site_key=site_key)


def _existing(spark: SparkSession, path: str) -> str | None:
    """The path when the file system has it (any Hadoop file system)."""
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return path if hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path) else None


def read_skipped_works(spark: SparkSession, path: str) -> DataFrame:
    """Skip list stored as one JSON object ``{slug: {url, title, time, reason}}``."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,struct<url:string,title:string,time:string,reason:string>>")
    return raw.select(F.explode(entries).alias("slug", "e")).select("slug", "e.*")


def latest_versions(rows: DataFrame, *, key: list[str], version: str) -> DataFrame:
    """Newest row per key of an append-only table."""
    return keep_first(rows, key=key, order=[F.col(version).desc()])
