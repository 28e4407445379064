"""Raw files in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import fixed_values as V
from ..schemas import CHUNK_METADATA

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def upload_columns(files: DataFrame) -> DataFrame:
    """Name, length, order and time of each raw file, from the binaryFile layout; files of
    one time are ordered by path."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path",
        name.alias("filename"),
        "length",
        "content",
        F.col("modificationTime").alias("created_at"),
        F.unix_micros("modificationTime").alias("ingest_order"),
    )


def read_uploads(
    spark: SparkSession, path: str, recursive: bool = True, max_bytes: int = V.DOCUMENT_MAX_BYTES
) -> DataFrame:
    """Every file below ``path``.  Unknown types are kept: validation names them.  Spark's
    file sources pass over files without a byte; uploads that come as a table keep them
    and validation rejects them as empty.

    Files are judged by their length first: one beyond ``max_bytes`` comes with null
    content, from the listing alone; only the others are opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    fits = reader.load(path).where(F.col("length") <= max_bytes)
    beyond = reader.load(path).where(F.col("length") > max_bytes).drop("content").withColumn("content", F.lit(None).cast("binary"))
    return upload_columns(fits.unionByName(beyond))


def read_text_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Only files a parser exists for; the suffix test is on the path, so other files'
    bytes are never loaded."""
    suffix = "|".join(e.replace(".", "\\.") for e in V.TEXT_EXTENSIONS)
    return read_uploads(spark, path).where(F.lower("path").rlike(f"({suffix})$"))


def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_audit(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append audit events as JSON lines {timestamp, event_type, details}."""
    events.select("timestamp", "event_type", "details").write.mode(mode).option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    ).json(path)


def decode_json_columns(
    df: DataFrame, schemas: dict[str, StructType | str]
) -> DataFrame:
    """Turn JSON text columns into typed ones, in place."""
    return df.withColumns({name: F.from_json(name, schema) for name, schema in schemas.items()})


def decode_chunk_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored chunk rows, whose embedding and metadata are JSON texts: (decoded, malformed).

    Decoded rows have an array of doubles and the fields of CHUNK_METADATA.  A row one of
    whose texts cannot be read, or whose vector holds anything but numbers, stays as it was,
    with ``problem`` naming the column (the embedding first); a null text cannot be read.
    """
    vector = F.when(F.col("embedding").rlike(r"(?s)\A\s*\[.*\]\s*\z"), F.from_json("embedding", "array<double>"))
    fields = F.from_json(
        "metadata", f"{CHUNK_METADATA}, _unread string", {"columnNameOfCorruptRecord": "_unread"}
    )
    read = rows.withColumns({"_vector": vector, "_fields": fields})
    no_vector = F.col("_vector").isNull() | F.exists("_vector", lambda x: x.isNull())
    no_fields = F.col("_fields").isNull() | F.col("_fields._unread").isNotNull()
    read = read.withColumn("problem", F.when(no_vector, "embedding").when(no_fields, "metadata"))
    others = [c for c in rows.columns if c not in ("embedding", "metadata")]
    decoded = read.where("problem is null").select(
        *others, F.col("_vector").alias("embedding"), F.col("_fields").dropFields("_unread").alias("metadata")
    )
    return decoded, read.where("problem is not null").select(*rows.columns, "problem")
