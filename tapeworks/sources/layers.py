"""Reading and writing layers: session-partitioned Parquet with fixed schemas, manifests, file digests."""

from __future__ import annotations

import hashlib
import json
import uuid
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaMismatch(ValueError):
    """A table's columns are not those of its layer."""


class ReadBackError(ValueError):
    """A table that was just written holds other rows."""


def enforce(df: DataFrame, ddl: str) -> DataFrame:
    """The layer's columns in its order and types; missing or unexpected columns are an error."""
    wanted = T.StructType.fromDDL(ddl)
    missing, odd = set(wanted.names) - set(df.columns), set(df.columns) - set(wanted.names)
    if missing or odd:
        raise SchemaMismatch(f"missing {sorted(missing)}, unexpected {sorted(odd)}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in wanted])


def same_types(df: DataFrame, ddl: str) -> bool:
    """Names, order and types, whatever Parquet made of nullability."""
    return [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in T.StructType.fromDDL(ddl)]


def write_layer(df: DataFrame, ddl: str, path: str, order: list[str]) -> DataFrame:
    """Writes a layer partitioned by session, refuses a folder that is there, and returns it as read back: of the layer's types,
    and with the rows that were written.

    Rows are counted and their hashes added up while they are written, and again as they are read back, so nothing is worked out
    twice; only a table that reads back the same gets its name."""
    spark, staging = df.sparkSession, f"{path}.writing-{uuid.uuid4().hex}"
    fs, place = _file_system(spark, path)
    if fs.exists(place):
        raise FileExistsError(f"{path} already exists")
    out = enforce(df, ddl).repartition("session_date").sortWithinPartitions("session_date", *order)
    seen = Observation()
    out.observe(seen, *_tally(out)).write.option("compression", "zstd").partitionBy("session_date").parquet(staging)
    back = read_layer(spark, ddl, staging)
    if not same_types(back, ddl):
        raise SchemaMismatch(f"{path} reads back as {back.schema.simpleString()}")
    found = back.agg(*_tally(back)).first().asDict()
    if found != seen.get:
        raise ReadBackError(f"{path}: written {seen.get}, read back {found}")
    if not fs.rename(_file_system(spark, staging)[1], place):
        raise FileExistsError(f"{path} already exists")
    return read_layer(spark, ddl, path)


def _tally(df: DataFrame) -> list[Column]:
    """How many rows, and the sum of their hashes, whatever their order."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(20,0)")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(30,0)")).alias("hashes")]


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def read_layer(spark: SparkSession, ddl: str, path: str, session: str | None = None) -> DataFrame:
    """A layer, or one session of it (other sessions' files are not opened)."""
    df = spark.read.parquet(path)
    df = df.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(ddl)])
    return df.where(F.col("session_date") == F.lit(session).cast("date")) if session else df


def differing_rows(a: DataFrame, b: DataFrame) -> int:
    """Rows of either table that the other lacks, repeats counted: 0 is exact equality."""
    return a.exceptAll(b).count() + b.exceptAll(a).count()


def write_manifest(df: DataFrame, path: str) -> None:
    """A summary DataFrame as JSON lines; one row a session."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def write_json(value: dict, path: str) -> None:
    """A driver-side manifest on the driver's own disk; numbers that are not finite are an error. For a shared file system:
    ``write_manifest``."""
    Path(path).write_text(json.dumps(value, indent=1, allow_nan=False))


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text())


def verify_artifacts(root: str, artifacts: list[dict]) -> list[str]:
    """What is wrong with files listed as {path, bytes, sha256}: unsafe or missing paths, other sizes or digests."""
    wrong = []
    for item in artifacts:
        relative = PurePosixPath(item["path"])
        target = Path(root) / relative
        if relative.is_absolute() or ".." in relative.parts:
            wrong.append(f"{relative}: unsafe path")
        elif not target.is_file():
            wrong.append(f"{relative}: missing")
        else:
            with target.open("rb") as f:
                digest = hashlib.file_digest(f, "sha256").hexdigest()
            if target.stat().st_size != item["bytes"]:
                wrong.append(f"{relative}: size")
            if digest != item["sha256"]:
                wrong.append(f"{relative}: digest")
    return wrong


# --- files of a folder on any file system that Spark reads


class DigestError(ValueError):
    """Files are not those of their manifest."""


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, session, bytes, sha256) for each file below a folder, hidden ones and markers left out: paths relative to it, the
    session from the path (null: none). Executors read and hash the files; only digests leave them."""
    fs, root = _file_system(spark, path)
    base = fs.makeQualified(root).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    relative = F.substring_index("path", f"{base}/", -1)
    session = F.regexp_extract(relative, r"session_date=(\d{4}-\d{2}-\d{2})(?:/|$)", 1)
    day = F.when(session != "", session).cast("date")
    return files.select(relative.alias("path"), day.alias("session"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def differing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem) for each file that is not as in the manifest: ``missing``, ``extra``, ``size``, ``digest``; and ``listed
    twice`` for a path that the manifest has more than once."""
    listed = manifest.groupBy("path").agg(F.count("*").alias("times"), F.first("bytes").alias("m_bytes"), F.first("sha256").alias("m_sha256"))
    both = listed.join(files.select("path", "bytes", "sha256"), "path", "full")
    problem = (
        F.when(F.col("times").isNull(), "extra").when(F.col("sha256").isNull(), "missing").when(F.col("times") > 1, "listed twice")
        .when(F.col("bytes") != F.col("m_bytes"), "size").when(F.col("sha256") != F.col("m_sha256"), "digest")
    )
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def session_files(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_date, problem): a session without a file, with several (``duplicate``), or a file of a session that is not wanted
    (``extra``). sessions: a row for each wanted session_date."""
    have = files.where("session IS NOT NULL").groupBy(F.col("session").alias("session_date")).agg(F.count("*").alias("files"))
    both = sessions.select("session_date", F.lit(1).alias("wanted")).distinct().join(have, "session_date", "full")
    problem = F.when(F.col("files").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("files") > 1, "duplicate")
    return both.select("session_date", problem.alias("problem")).where("problem IS NOT NULL")


def folder_digest(spark: SparkSession, path: str) -> str:
    """One digest of a folder's files, names and contents: of the list of their paths and digests, in order."""
    listed = file_digests(spark, path).agg(F.sort_array(F.collect_list(F.concat_ws(" ", "path", "sha256"))).alias("x"))  # a line a file
    return listed.select(F.sha2(F.array_join("x", "\n"), 256)).first()[0]
