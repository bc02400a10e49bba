"""Helpers shared by the training-data operators: the shared folder, tables
written to cut lineage, and fast access to texts in Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines of the cluster share: ``spark.checkpoint.dir``
    of the session. Where it is unset, a local master gets a temporary folder;
    on a cluster that is an error, since executors can't see such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    held = context.getCheckpointDir()
    if held is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="evoka-"))
        held = context.getCheckpointDir()
    return held.rstrip("/")


_folders: list[str] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; ``clear_folders`` removes it."""
    path = f"{shared_dir(spark)}/evoka-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
    _folders.append(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _folders.remove(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that no later plan reads."""
    for table in tables:
        _remove(table.sparkSession, _path_of.pop(table))


def settled(spark: SparkSession, make, name: str) -> DataFrame:
    """The rows of ``make()``, written; the tables that operators wrote on the way
    to them are removed."""
    before = len(_folders)
    out = written(make(), name)
    for path in _folders[before:]:
        if path != _path_of[out]:
            _remove(spark, path)
    return out


def clear_folders(spark: SparkSession) -> None:
    """Removes all tables that operators of this process have written."""
    for path in list(_folders):
        _remove(spark, path)


@atexit.register
def _clear_local() -> None:
    for path in _folders:
        if path.startswith(("file:", "/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back, so a
    lost executor costs a re-read instead of the whole lineage."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _path_of[table] = path
    return table


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


#: Parts over which rows without an id are spread in joins by ids.
NULL_PARTS = 1024


def join_keys(id_col: str, text_col: str) -> list:
    """(__evoka_id, __evoka_part) of a row: its id, and for rows without one, of
    which there may be very many, a part by the text (-1 for all others)."""
    own = F.col(id_col).cast("long")
    part = F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(NULL_PARTS)).cast("int")
    return [own.alias("__evoka_id"), F.when(own.isNull(), part).otherwise(-1).alias("__evoka_part")]


def by_keys(ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``ids``, each once, under the names of ``join_keys``; a null id has a row for
    each part."""
    parts = F.when(F.col(id_col).isNull(), F.sequence(F.lit(0), F.lit(NULL_PARTS - 1))).otherwise(F.array(F.lit(-1)))
    others = [c for c in ids.columns if c != id_col]
    return ids.select(F.col(id_col).alias("__evoka_key"), *others, F.explode(parts).alias("__evoka_key_part"))


def same_keys():
    """The condition that joins rows with ``join_keys`` to those of ``by_keys``.
    Null-safe in both, so that no filter on nulls is put before the exchange."""
    return F.col("__evoka_id").eqNullSafe(F.col("__evoka_key")) & F.col("__evoka_part").eqNullSafe(F.col("__evoka_key_part"))


def combined(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
