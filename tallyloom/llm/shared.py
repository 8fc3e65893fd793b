"""Session helpers of the corpus operators: shared folders, training folds, small reads."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut, place, shared_dir, stored, temporary  # noqa: F401


#: Cut the lineage through a reliable checkpoint in the shared folder.
checkpoint = cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in fold 0."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(parts)), F.lit(0)).cast("int")


def collect_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of results that nothing refers to any more.

    It does so when the driver collects garbage, which a driver with much memory rarely does.
    """
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that no result reads any more."""
    for df in tables:
        found, fs = place(df.sparkSession, df._stored_at)
        fs.delete(found, True)


#: Plan nodes that keep one row of a file one row.
_ROWWISE = ("Project", "Filter", "SubqueryAlias", "LogicalRelation")


def _is_scan(df: DataFrame) -> bool:
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in _ROWWISE:
        if node.children().isEmpty():
            return node.relation().getClass().getSimpleName() == "HadoopFsRelation" and node.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"
        node = node.children().head()
    return False


#: Columns that tell a row by its place: which file, and where in it.
PLACE = ("__file", "__at")


def scanned(df: DataFrame) -> DataFrame:
    """df itself if its rows come straight from Parquet files, else a written copy."""
    return df if _is_scan(df) else stored(df, "input")


def located(df: DataFrame) -> DataFrame:
    """df with the columns PLACE, which name a row alike in every scan, however its files are split.

    Only Parquet scans have places; any other input is first written to the shared folder.
    """
    return scanned(df).select("*", F.xxhash64("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))


def buckets(df: DataFrame, bytes_each: int) -> int:
    """How many parts to deal something into that grows with df's files, so that a part's size does not."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(parts(df.sparkSession), -(-min(size, 1 << 56) // bytes_each))


def hot_keys(counted: DataFrame, key: str, total: int, most: int = 500) -> list:
    """Keys with more than 1/most of all rows, so fewer than ``most``. counted: key, n."""
    return [r[0] for r in counted.where(F.col(key).isNotNull() & (F.col("n") > max(1000, total // most))).select(key).collect()]


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """left join right on one key column; right has one row a key at most. how: inner or left.

    A hot key would gather its rows in one task. Its row of ``right`` is sent to left's
    rows instead (there are fewer than 500 of these, see ``hot_keys``); all other keys
    are joined as usual. ``left`` should be a written table or a checkpoint, since it
    is read again.
    """
    if hot is None:
        hot = hot_keys(left.groupBy(key).agg(F.count("*").alias("n")), key, left.count())
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.where(is_hot).join(F.broadcast(right.where(F.col(key).isin(hot))), key, how).unionByName(left.where(~is_hot).join(right, key, how))


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def extended(schema: T.StructType, **columns: str) -> T.StructType:
    """A copy of the schema with more columns, by name and simple type."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}
    return T.StructType([*schema.fields, *(T.StructField(k, kinds[v]) for k, v in columns.items())])
