"""Recordings from files: CSV folders of differing headers, WAV signals, and sinks."""

from __future__ import annotations

import csv
import io
import re
import struct
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ISO-8859-1 reads any bytes, so no later encoding would ever be tried.
ENCODINGS, SEPARATORS = ("UTF-8", "ISO-8859-1"), (",", ";", "\t", "|")
PREFERRED = ("merged_data", "hrv_data", "physiological_data")


def normalise_header(name: str) -> str:
    """Cut at the first parenthesis and trimmed: `heart_rate [bpm](/api/datatype/19/)` is `heart_rate [bpm]`."""
    return name.split("(", 1)[0].rstrip()


def snake_header(name: str) -> str:
    """Without (/api...) and brackets; spaces and slashes as underscores."""
    name = re.sub(r"\(/api[^)]*\)", "", name)
    return re.sub(r"[ /]", "_", re.sub(r"[\[\]]", "", name)).strip("_")


def normalise_headers(df: DataFrame, rule=normalise_header) -> DataFrame:
    """Columns renamed by a rule; names that collide get _2, _3."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        new = rule(c)
        seen[new] = seen.get(new, 0) + 1
        names.append(new if seen[new] == 1 else f"{new}_{seen[new]}")
    return df.toDF(*names)


def csv_shape(content: bytes) -> tuple[str, str, list[str]]:
    """Encoding, separator and header of a CSV file: the first of both that give more than one row and column, else the first ones."""
    for encoding in ENCODINGS:
        try:
            text = content.decode(encoding)
        except UnicodeDecodeError:
            continue
        top = list(islice(filter(str.strip, io.StringIO(text)), 3))
        for sep in SEPARATORS if len(top) == 3 else ():
            head = next(csv.reader([top[0]], delimiter=sep))
            if len(head) > 1:
                return encoding, sep, head
    return ENCODINGS[0], SEPARATORS[0], []


def probe_csvs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, encoding, sep, header of each file, found on the executors in one job; empty files have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = [csv_shape(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[k] for x in shapes], pa.string()) for k in (0, 1)], pa.array([x[2] for x in shapes], pa.list_(pa.string()))], names=["path", "encoding", "sep", "header"])

    files = spark.read.format("binaryFile").load(list(paths)).select(F.url_decode("path").alias("path"), "content")
    return files.mapInArrow(run, "path string, encoding string, sep string, header array<string>")


def read_csvs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All files by normalised header: one read per encoding, separator and header, missing columns null, with source_file.

    Sol and subject are taken from the path where it has `Sol N` and `T##_Name`. The driver holds a row per file.
    """
    groups: dict[tuple, list[str]] = {}
    for r in probe_csvs(spark, paths).orderBy("path").collect() if paths else ():
        groups.setdefault((r["encoding"], r["sep"], tuple(r["header"])), []).append(r["path"])
    out = None
    for (encoding, sep, _), own in groups.items():
        d = spark.read.option("header", True).option("encoding", encoding).option("sep", sep).csv(own)
        d = normalise_headers(d).withColumn("source_path", F.input_file_name())
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files with rows")
    plain = F.url_decode("source_path")
    return out.withColumns(
        {
            "source_file": F.element_at(F.split(plain, "/"), -1),
            "Sol": F.regexp_extract(plain, r"Sol ?(\d+)", 1).try_cast("int"),
            "subject": F.regexp_extract(plain, r"(T\d+_[^/_.]+)", 1),
        }
    ).drop("source_path")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, sol, subject, size of the CSV files below a folder like `Sol N (...)/.../T##_Name/`."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path", "length")
    plain = F.url_decode("path")
    return d.select(plain.alias("path"), F.regexp_extract(plain, r"Sol (\d+)", 1).try_cast("int").alias("sol"), F.regexp_extract(plain, r"(T\d+_[^/]+)/", 1).alias("subject"), F.col("length").alias("size"))


def missing_files(found: DataFrame) -> DataFrame:
    """The (subject, sol) pairs of the grid of subjects and sols seen without a file."""
    grid = found.select("subject").distinct().join(found.select("sol").distinct())  # subjects x days, a small dimension
    return grid.join(found.select("subject", "sol"), ["subject", "sol"], "left_anti")


def header_report(long: DataFrame) -> DataFrame:
    """From (file, header): header, number of files, and whether all files have it."""
    files = long.select("file").distinct().count()
    return long.groupBy("header").agg(F.count_distinct("file").alias("n_files")).withColumn("common", F.col("n_files") == files)


def to_canonical(df: DataFrame) -> DataFrame:
    """time_seconds from `time [s/1000]` or `time [s/256]`, the usual columns, null where a file has none."""
    have = {c.lower(): c for c in df.columns}
    ticks = [F.col(f"`{have[f'time [s/{k}]']}`").try_cast("double") / k for k in (1000, 256) if f"time [s/{k}]" in have]
    out = df.withColumn("time_seconds", F.coalesce(*ticks) if ticks else F.lit(None).cast("double"))
    usual = ("breathing_rate [rpm]", "minute_ventilation [mL/min]", "sleep_position [NA]", "activity [g]", "heart_rate [bpm]", "cadence [spm]")
    values = [(F.col(f"`{have[c.lower()]}`").try_cast("double") if c.lower() in have else F.lit(None).cast("double")).alias(c) for c in usual]
    keys = [c for c in ("subject", "Sol", "source_file") if c in df.columns]
    return out.select(*keys, "time_seconds", *values)


def epoch_columns(df: DataFrame, millis: str) -> DataFrame:
    return df.withColumn("ts", F.timestamp_millis(F.col(millis).cast("long")))


def load_table(spark: SparkSession, name: str | None = None) -> DataFrame:
    """The named table, or the first of the usual names, or the first of the catalog."""
    have = [t.name for t in spark.catalog.listTables()]
    for wish in ([name] if name else [*PREFERRED, *sorted(have)]):
        if wish in have:
            return spark.table(wish)
    raise ValueError(f"no table among {have}")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows, the same ones each time: those of least hash of key and seed."""
    return df.withColumn("pl_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("pl_h", key).limit(n).drop("pl_h")


SAMPLES = "signal_id string, channel int, i long, t double, value double"


def decode_wav(content: bytes) -> tuple[dict, np.ndarray]:
    """The header's fields and the samples as frames x channels, unsigned for one byte, signed for two and four."""
    at, info, data = 12, {}, b""
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, at + 8)
            info = {"channels": channels, "rate": rate, "width": bits // 8}
        elif name == b"data":
            data = content[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    kind = {1: "u1", 2: "<i2", 4: "<i4"}[info["width"]]
    values = np.frombuffer(data[: len(data) // (info["width"] * info["channels"]) * info["width"] * info["channels"]], kind)
    return info, values.reshape(-1, info["channels"]).astype(float)


def read_wavs(spark: SparkSession, root: str, folder: bool = False) -> DataFrame:
    """signal_id (file name), channel, i, t (seconds), value of all WAV files below a folder; one row per sample and channel; their folder where asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, place, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                info, values = decode_wav(content.as_py())
                for lo in range(0, len(values), 1 << 18):
                    part = values[lo : lo + (1 << 18)]
                    i = np.repeat(np.arange(lo, lo + len(part)), info["channels"])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array(np.tile(np.arange(info["channels"], dtype=np.int32), len(part))), pa.array(i), pa.array(i / info["rate"]), pa.array(part.ravel()), pa.array([place] * len(i), pa.string())], names=["signal_id", "channel", "i", "t", "value", "folder"])

    d = files.select(F.element_at(F.split(F.url_decode("path"), "/"), -1).alias("signal_id"), _folder(F.col("path")).alias("folder"), "content").mapInArrow(run, SAMPLES + ", folder string")
    return d if folder else d.drop("folder")


def read_infos(spark: SparkSession, root: str) -> DataFrame:
    """folder, start (seconds), start_date, user, devices from the info.json files below a folder; what a file lacks or has in a wrong form is null."""
    d = spark.read.schema("timestamp string, start_date string, user string, devices string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "info.json").json(root)
    start = F.col("timestamp").try_cast("double")
    devices = F.coalesce(F.array_join(F.from_json("devices", "array<string>"), ", "), F.col("devices"))
    return d.select(_folder(F.input_file_name()).alias("folder"), F.when(start > 0, start).alias("start"), "start_date", "user", devices.alias("devices"))


def _folder(path: Column) -> Column:
    """The path without its scheme and its last part."""
    return F.regexp_replace(F.regexp_replace(F.url_decode(path), r"^[a-z]+:/+", "/"), r"/[^/]*$", "")


def read_recordings(spark: SparkSession, root: str) -> DataFrame:
    """read_wavs with ts (the time of the sample; null without a start in the folder's info.json), start_date, user and devices."""
    d = read_wavs(spark, root, folder=True).join(read_infos(spark, root), "folder", "left")
    return d.withColumn("ts", F.timestamp_micros(((F.col("start") + F.col("t")) * 1e6).cast("long"))).drop("folder", "start")


def write_samples(df: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet by subject, sorted by day and time within files."""
    df.repartition("subject").sortWithinPartitions("sol", "t").write.mode(mode).partitionBy("subject").parquet(path)


def write_metrics(df: DataFrame, path: str, kind: str = "csv", mode: str = "error") -> None:
    """Metric tables as CSV with a header, JSON lines or Parquet."""
    {"csv": lambda w: w.option("header", True).csv(path), "json": lambda w: w.json(path), "parquet": lambda w: w.parquet(path)}[kind](df.write.mode(mode))
