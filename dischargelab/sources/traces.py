"""Reading and writing recordings, libraries and sort results.

Text recordings hold one float per line. Spark splits large files, so a line's index is derived
from (file, split start, position in split), which orders lines whatever the split layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dischargelab.operators.ordered import row_index
from dischargelab.session import attach

DEFAULT_FS = 24000.0


def read_text_traces(spark: SparkSession, glob: str) -> DataFrame:
    """(run_id, i, v) for every file matching ``glob``.

    The run id is the file's whole path without suffix: recordings of different subjects often have
    the same file name. ``run_name`` gives the name alone.
    """
    lines = spark.read.text(glob).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m")).where(F.length(F.trim("value")) > 0)
    rows = row_index(lines, ["file"], ["_b", "_m"], "i")
    return rows.select(F.regexp_replace("file", r"\.[^./]*$", "").alias("run_id"), "i", F.trim("value").cast("double").alias("v"))


def run_name(run: str = "run_id") -> Column:
    """The last part of a run's path."""
    return F.element_at(F.split(F.col(run), "/"), -1)


def slice_rows(trace: DataFrame, fs: float, start_s: float = 0.0, duration_s: float | None = None) -> DataFrame:
    """Rows [round(start*fs), + round(duration*fs)), re-indexed from zero; an empty range is an error."""
    lo = round(start_s * fs)
    rows = trace.where(F.col("i") >= lo)
    if duration_s is not None:
        rows = rows.where(F.col("i") < lo + round(duration_s * fs))
    if rows.isEmpty():
        raise ValueError("the requested range holds no samples")
    return rows.withColumn("i", F.col("i") - lo)


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(file, fs): first entry per file of a tab-separated header with at least four fields."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    f = lines.withColumn("_f", F.split("value", "\t")).where(F.size("_f") >= 4)
    rate = F.try_element_at("_f", F.lit(3)).try_cast("double")
    first = f.select(F.trim(F.col("_f")[3]).alias("file"), rate.alias("fs"), F.struct("_b", "_m").alias("_o")).where("fs is not null")
    return first.groupBy("file").agg(F.min_by("fs", "_o").alias("fs"))


def with_sample_rate(runs: DataFrame, header: DataFrame, file: str = "file", default: float = DEFAULT_FS) -> DataFrame:
    h = header.select(F.col("file").alias("_hf"), F.col("fs").alias("_fs"))
    return runs.join(h, F.col(file) == F.col("_hf"), "left").withColumn("fs", F.coalesce("_fs", F.lit(default))).drop("_hf", "_fs")


def run_bounds(runs: DataFrame, keys: list[str], run: str = "run_id", n: str = "n") -> DataFrame:
    """Start and end sample of every run once runs are laid end to end in name order."""
    w = Window.partitionBy(*keys).orderBy(run).rowsBetween(Window.unboundedPreceding, 0)  # one row per run
    return runs.withColumn("end", F.sum(n).over(w)).withColumn("start", F.col("end") - F.col(n))


def concatenate(trace: DataFrame, keys: list[str], run: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """(joined trace without the run, bounds): runs follow each other in name order."""
    sizes = trace.groupBy(*keys, run).agg(F.count(F.lit(1)).alias("n"))
    bounds = run_bounds(sizes, keys, run)
    joined = attach(trace, bounds.select(*keys, run, "start"), keys + [run]).select(*keys, (F.col("i") + F.col("start")).alias("i"), "v")
    return joined, bounds


def write_text_trace(trace: DataFrame, fs: float, path: str) -> None:
    """One directory per run with ``%.6f`` lines in sample order, and a header row per run beside it.

    Runs that are already at ``path`` stay; a run that is written again replaces its lines and its header row.
    """
    lines = trace.select("run_id", "i", F.format_string("%.6f", F.col("v").cast("double")).alias("value"))
    (lines.repartitionByRange("run_id", "i").sortWithinPartitions("run_id", "i").select("run_id", "value")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").text(f"{path}/lines"))
    head = trace.groupBy("run_id").agg(F.count(F.lit(1)).alias("Samples")).select(
        "run_id", F.lit("EMGRUN").alias("Type"), "Samples", F.lit(int(fs)).alias("SmplFrq"), F.concat("run_id", F.lit(".txt")).alias("File"))
    (head.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("sep", "\t").option("header", True)
     .partitionBy("run_id").csv(f"{path}/Header"))


def read_written_trace(spark: SparkSession, path: str) -> DataFrame:
    """The counterpart of ``write_text_trace``; part files are numbered in sample order. Run ids are text, as written."""
    lines = spark.read.schema("value string, run_id string").text(f"{path}/lines").select(
        "run_id", F.col("value"), F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"))
    return row_index(lines, ["run_id"], ["_f", "_b", "_m"], "i").select("run_id", "i", F.col("value").cast("double").alias("v"))


def through_text(trace: DataFrame) -> DataFrame:
    """The rounding a recording undergoes when it is written with six decimals and read back."""
    return trace.withColumn("v", F.bround("v", 6))


def path_parts(path) -> list:
    """Subject, muscle and side from ``.../subject/EMG/muscle/side[/file]`` directories."""
    p = F.split(path, "/")
    return [F.element_at(p, -5).alias("subject"), F.element_at(p, -3).alias("muscle"), F.element_at(p, -2).alias("side")]


def place_label(path):
    """``subject/muscle_side`` for display."""
    p = F.split(path, "/")
    return F.concat(F.element_at(p, -5), F.lit("/"), F.element_at(p, -3), F.lit("_"), F.element_at(p, -2))


def default_data_path(data_dir: str, muscle: str, side: str) -> str:
    return f"{data_dir}/{muscle}_{side}_joint_sort"


# --- library and results -------------------------------------------------------------------------

LIBRARY_KEY = r"^(.*)_type(\d+)_(\w+)$"
UNIT_KEY = r"^unit\d+_(.*)_type(\d+)$"


def parse_library(flat: DataFrame, fields: list[str], min_trials: int = 100, key: str = "key", value: str = "value") -> DataFrame:
    """One row per (subject, type_idx) from flat ``subject_typeN_field`` keys; thin entries are dropped."""
    parts = flat.select(F.regexp_extract(key, LIBRARY_KEY, 1).alias("subject"), F.regexp_extract(key, LIBRARY_KEY, 2).alias("_t"),
                        F.regexp_extract(key, LIBRARY_KEY, 3).alias("_f"), F.col(value).alias("_v")).where("_t <> ''")
    rows = parts.withColumn("type_idx", F.col("_t").cast("int")).groupBy("subject", "type_idx").pivot("_f", fields).agg(F.first("_v"))
    return rows.where(F.col("n_spikes").cast("long") >= min_trials)


def join_truth_library(units: DataFrame, library: DataFrame, name: str = "name") -> DataFrame:
    """Attach to each ``unitN_subject_typeM`` its library entry; a missing entry is an error."""
    keyed = units.withColumn("subject", F.regexp_extract(name, UNIT_KEY, 1)).withColumn(
        "type_idx", F.regexp_extract(name, UNIT_KEY, 2).cast("int"))
    if not keyed.join(library, ["subject", "type_idx"], "left_anti").isEmpty():
        raise KeyError("a simulated unit has no library entry")
    return keyed.join(library, ["subject", "type_idx"])


def library_index(entries: DataFrame) -> DataFrame:
    cols = ["subject", "category", "muscle", "side", "type_idx", "n_spikes", "n_runs_present", "fs", "duration_ms", "amplitude",
            "firing_rate_hz", "phases", "turns"]
    return entries.select(*cols)


def run_type_grid(spikes: DataFrame, run: str = "run_id", label: str = "label") -> DataFrame:
    """Spike count of every run x type cell, empty cells included (runs and types, not spikes)."""
    cells = spikes.select(run).distinct().crossJoin(spikes.select(label).distinct())
    counts = spikes.groupBy(run, label).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(counts, [run, label], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def feature_table(spikes: DataFrame, n_shape: int, method: str, features: str = "features") -> DataFrame:
    """Per-spike export: index, time, raw peak, amplitude, duration, polarity, shape columns, label."""
    idx = row_index(spikes, ["run_id"], ["t", "spike_id"], "spike_index")
    return idx.select("run_id", "spike_index", F.col("t").alias("time_s"), F.col("amp").alias("peak_amplitude_raw"), "amplitude", "duration_ms",
                      "polarity", *[F.col(features)[k].alias(f"{method}_dim{k + 1}") for k in range(n_shape)], F.col("label").alias("cluster_label"))


def write_sort(spikes: DataFrame, path: str) -> None:
    """Sorted spikes as Parquet, one directory per run and label; several files share a hot one."""
    spikes.write.mode("overwrite").partitionBy("run_id", "label").parquet(path)


def load_sort(spark: SparkSession, path: str, **where) -> DataFrame:
    rows = spark.read.parquet(path)
    for col, v in where.items():
        rows = rows.where(F.col(col) == v)
    return rows
