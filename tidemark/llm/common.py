"""Helpers the corpus operators share: shared storage, text normalisation, joins that survive hot keys."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"

#: A key holding at least this share of all rows is hot; so there can be at most this many hot keys.
MAX_HOT_KEYS = 1000


#: Shuffle files of a query are removed as soon as it has ended.
EARLY_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder set on the context.

    Where neither is set, a local session gets a folder of its own; on a cluster, whose machines would each write to their own disk, that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        configured = context._jsc.sc().getCheckpointDir().get()
    return configured.rstrip("/")


def materialize(df: DataFrame, label: str, bucket_by: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors.

    bucket_by: a column by whose hash the rows are dealt over the files, so that a later join or grouping on it moves none of them. Nothing reads the shuffles behind it again, so their files go when the write has ended. The table is removed by `discard`, or when the application ends."""
    spark = df.sparkSession
    name = f"{label}-{uuid.uuid4().hex}"
    path, registered = f"{shared_dir(spark)}/{name}", name.replace("-", "_")
    former = spark.conf.get(EARLY_CLEANUP, "false")
    spark.conf.set(EARLY_CLEANUP, "true")
    try:
        if bucket_by:
            buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
            df.write.format("parquet").option("path", path).bucketBy(buckets, bucket_by).saveAsTable(registered)
        else:
            df.write.parquet(path)
    finally:
        spark.conf.set(EARLY_CLEANUP, former)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    back = spark.table(registered) if bucket_by else spark.read.schema(df.schema).parquet(path)
    back._written_to, back._registered = path, registered if bucket_by else None
    return back


def discard(*tables: DataFrame) -> None:
    """Remove tables that `materialize` wrote and that nothing will read again."""
    for df in tables:
        if df._registered:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._registered}")
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text as bigint; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lookup_join(rows: DataFrame, unique: DataFrame, key: str, count: str, total: int, salt_by: list[str], how: str = "left", salts: int = 64) -> DataFrame:
    """Join rows with a table that has each key once, however unevenly the rows are dealt over the keys.

    `unique` has the number of rows of each key in column `count`. A key with more than total / MAX_HOT_KEYS rows
    is hot: there are at most MAX_HOT_KEYS such keys, so their list may be broadcast. Rows of hot keys are dealt
    over `salts` partitions by the hash of their `salt_by` columns (the same after a retry), and the hot keys' entries
    repeated for each salt; other keys keep salt 0. No row is dropped and every row is joined exactly once. Rows with a
    null key stay unmatched."""
    hot_from = max(1000, total // MAX_HOT_KEYS)
    hot = unique.where(F.col(count) > hot_from).select(F.col(key).alias("_hot_key"))
    salted = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_salt", F.when(F.col("_hot_key").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    ).drop("_hot_key")
    entries = unique.withColumn(
        "_salt", F.explode(F.when(F.col(count) > hot_from, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    )
    return salted.join(entries, [key, "_salt"], how).drop("_salt")


def maybe_among(rows: DataFrame, digest: Column, wanted: DataFrame, column: str, bits: int = 1 << 25) -> DataFrame:
    """The rows whose 64-bit digest is in a column of `wanted`, and a few others, without moving any row.

    The digests' low bits are marked in a bitmap of fixed size, which is broadcast (4 MB). No wanted row is left out; the share of the others that come
    along grows with the number of wanted digests, up to all of them, so a join is to follow."""
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    marked = wanted.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("marks")).toArrow()  # at most bits / 64 rows
    marks = np.zeros(bits // 64, np.int64)
    marks[marked.column("at").to_numpy()] = marked.column("marks").to_numpy()
    table_of_one = rows.sparkSession.createDataFrame(pa.table({"_marks": pa.array([marks], pa.list_(pa.int64()))}))
    here = digest.bitwiseAND(F.lit(bits - 1))
    return rows.join(F.broadcast(table_of_one), F.getbit(F.get("_marks", F.shiftright(here, 6).cast("int")), here.bitwiseAND(F.lit(63)).cast("int")) == 1, "left_semi")


def quoted(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def whole_rows(df: DataFrame, **helpers: Column) -> DataFrame:
    """(row, helpers...): all columns of a row in one struct, so that no helper can clash with them, whatever their names."""
    return df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), *[value.alias(name) for name, value in helpers.items()])


def taken_apart(df: DataFrame, columns: list[str], **added: Column) -> DataFrame:
    """The columns of `row` again; added columns take the place of those with their name."""
    kept = [F.col("row").getField(c).alias(c) for c in columns if c not in added]
    return df.select(*kept, *[value.alias(name) for name, value in added.items()])


def row_key(id_: Column, digest: Column) -> Column:
    """Id and digest of a row as text; null ids are equal to each other and to nothing else."""
    return F.concat(F.when(id_.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), id_.cast("string"))), F.lit(":"), digest.cast("string"))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow with the same columns before and after, whatever their names (it takes none with a dot): run sees them numbered."""
    numbered = T.StructType([T.StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(df.schema.fields)])
    return df.toDF(*numbered.names).mapInArrow(run, numbered).toDF(*df.columns)
