"""Reading and writing the stages' tables."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..config import Settings


def require_files(spark: SparkSession, paths: Sequence[str]) -> None:
    """Fails when any of the manifest's files is missing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    missing = [p for p in paths if not (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)]
    if missing:
        raise FileNotFoundError(", ".join(missing))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that the driver and all executors share,
    ``spark.checkpoint.dir``; where that is unset, a local master takes a
    temporary one, and a cluster fails."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evoka-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back: a lost
    executor costs a re-read, and later rounds don't carry the plans of earlier ones."""
    path = shared_folder(df.sparkSession, f"evoka-{name}")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _path_of[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that no later plan reads, wherever they are."""
    for table in tables:
        where = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_path_of.pop(table))
        where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table with a header, UTF-8 with or without a byte order mark. Without a
    schema types are inferred, which reads the file twice."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, number_format: str = "%.8g") -> None:
    """Doubles are written by ``number_format``, null as the empty field."""
    kinds = dict(df.dtypes)
    columns = [F.format_string(number_format, F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]
    df.select(*[F.when(F.col(c).isNotNull(), x).alias(c) for c, x in zip(df.columns, columns, strict=True)]).write.option("header", True).csv(path)


def with_recording_facts(df: DataFrame, path: Column | None = None, cfg: Settings = Settings()) -> DataFrame:
    """Adds file_name, subject and task, told from the file's name."""
    name = F.col("_metadata.file_name") if path is None else F.element_at(F.split(path, "/"), -1)
    out = df.withColumn("file_name", name)
    return out.withColumn("subject", told_by(F.col("file_name"), cfg.subject_marks)).withColumn("task", told_by(F.col("file_name"), cfg.task_marks))


def told_by(file_name: Column, marks: Sequence[tuple[str, str]]) -> Column:
    """What the first mark that the name holds says; null for no name."""
    found = F.lit(None).cast("string")
    for mark, meaning in reversed(marks):
        found = F.when(F.contains(file_name, F.lit(mark)), meaning).otherwise(found)
    return found


def labels_of(cells: Column) -> Column:
    """Channel labels of an array of cells, each an array of the characters or
    strings that make up one label."""
    return F.transform(cells, lambda cell: F.array_join(cell, ""))


def samples_of_matrix(recordings: DataFrame) -> DataFrame:
    """Long samples of recordings that hold a channel-by-time matrix in ``data``
    and as many ``labels``; other numbers of them fail."""
    whole = require(recordings, F.size("data") == F.size("labels"), "a matrix has not as many rows as labels")
    rows = whole.select("file_name", "labels", F.posexplode("data").alias("_row", "_values"))
    named = rows.withColumn("channel", F.get("labels", F.col("_row")))
    return named.select("file_name", "channel", F.posexplode("_values").alias("sample_idx", "value")).withColumn("sample_idx", F.col("sample_idx").cast("long"))


def write_epochs(epochs: DataFrame, path: str) -> None:
    """Values are kept in single precision, as arrays by trial and channel."""
    epochs.withColumn("values", F.col("values").cast("array<float>")).write.partitionBy("file_name").parquet(path)


def read_epochs(spark: SparkSession, path: str, n_times: int, columns: Sequence[str] = ("file_name", "trial_id", "channel", "values", "accepted", "cue_direction")) -> DataFrame:
    """Epochs in double precision; a row of another length, or with a value
    that isn't finite, fails the task that reads it."""
    rows = spark.read.parquet(path).select(*columns)
    values = F.col("values").cast("array<double>")
    whole = (F.size(values) == n_times) & F.forall(values, lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.withColumn("values", F.when(whole, values).otherwise(F.raise_error(F.lit("an epoch isn't whole")).cast("array<double>")))


#: Version of the archives that this library writes and reads.
ARCHIVE = 1


def _facts(cfg: Settings) -> dict:
    """What an archive says of its epochs, as plain values."""
    first = cfg.curve_windows[0]
    return {
        "version": ARCHIVE,
        "sample_rate_hz": float(cfg.sample_rate),
        "channel_labels": list(cfg.channels),
        "time_s": cfg.times(),
        "filter_band_hz": [float(x) for x in cfg.band_hz],
        "epoch_window_s": [float(x) for x in cfg.epoch_s],
        "baseline_window_s": [cfg.baseline.low, cfg.baseline.high],
        "first_window_s": [first.low, first.high],
    }


_FACTS = "version int, sample_rate_hz double, channel_labels array<string>, time_s array<double>, filter_band_hz array<double>, epoch_window_s array<double>, baseline_window_s array<double>, first_window_s array<double>"


def write_archive(epochs: DataFrame, folder: str, cfg: Settings = Settings(), correct: str | None = None) -> None:
    """Epochs and, beside them, one row of facts: version, rate, labels in order,
    time axis, band and windows. ``correct`` names a nullable boolean that is kept
    as ``behavior_code``: 1, 0, or -1 where it isn't known. The facts are written
    last, so a folder without them is no archive."""
    if correct is not None:
        epochs = epochs.withColumn("behavior_code", F.coalesce(F.col(correct).cast("int"), F.lit(-1)).cast("tinyint"))
    write_epochs(epochs, f"{folder}/epochs")
    row = _facts(cfg)
    epochs.sparkSession.createDataFrame([tuple(row.values())], _FACTS).coalesce(1).write.json(f"{folder}/facts")


def archive_facts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_FACTS).json(f"{folder}/facts")


def read_archive(spark: SparkSession, folder: str, cfg: Settings = Settings(), columns: Sequence[str] = ("file_name", "trial_id", "channel", "values")) -> DataFrame:
    """Epochs of an archive whose facts are those of ``cfg``; another version, rate,
    axis, window or order of labels is refused before an epoch is read. Channels
    that the labels don't name fail the task that reads them."""
    found = archive_facts(spark, folder).first()
    if found is None:
        raise ValueError("the folder has no facts of an archive")
    for name, want in _facts(cfg).items():
        if found[name] != want:
            raise ValueError(f"the archive's {name} is {found[name]}, not {want}")
    rows = read_epochs(spark, f"{folder}/epochs", len(cfg.times()), columns)
    return require(rows, F.col("channel").isin(*cfg.channels), "a channel isn't among the labels") if "channel" in columns else rows


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows; one that doesn't fit the condition fails its task."""
    ok = F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.where(ok)


def merged_by_place(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both tables side by side, by keys that each has once. A key that
    only one has, or one has twice, fails."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    uneven = count(a, "_a").join(count(b, "_b"), list(keys), "full_outer").where("coalesce(_a, 0) <> 1 or coalesce(_b, 0) <> 1")
    if not uneven.isEmpty():
        raise ValueError(f"tables don't match in {uneven.count()} keys, as in {uneven.first()}")
    return a.join(b, list(keys))


def checks(**facts: DataFrame) -> DataFrame:
    """(check, passed): for each name whether the one boolean of its one-row
    table holds; none and null don't. Each table is an aggregate."""
    rows = [df.select(F.lit(name).alias("check"), df[df.columns[0]].cast("boolean").alias("_ok")) for name, df in facts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("check", F.coalesce("_ok", F.lit(False)).alias("passed"))


def require_no_leakage(columns: Sequence[str], forbidden: Sequence[str]) -> None:
    """Feature names must not speak of the outcome."""
    bad = [c for c in columns if any(token in c.lower() for token in forbidden)]
    if bad:
        raise ValueError(f"features that tell the outcome: {', '.join(bad)}")
