"""Files: WAV headers, manifests as CSV, labels as nested JSON, and sinks for documents and report lines."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WAV = "path string, bytes long, sample_rate_hz int, channels int, bit_depth int, format string, data_bytes long"


def wav_format(read, size: int) -> tuple[int, int, int, str | None, int] | None:
    """(rate, channels, bits, format, bytes of sound) by walking over a WAV file's chunks; read(offset, n) gives bytes.
    None for anything else, and where the format or the data isn't found."""
    head = read(0, 12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, told = 12, None
    while at < size:
        head = read(at, 8)
        if len(head) < 8:
            return None
        name, n = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            body = read(at + 8, min(n, 40))
            if len(body) < 16:
                return None
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            code = struct.unpack("<H", body[24:26])[0] if code == 0xFFFE and len(body) >= 26 else code  # the extensible form names it later
            told = (rate, channels, bits, {1: "PCM", 3: "FLOAT"}.get(code))
        elif name == b"data":
            return (*told, max(0, min(n, size - at - 8))) if told else None
        at += 8 + n + n % 2
    return None


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few short reads a file, wherever it is, instead of its content."""
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64())
    names = [c.split()[0] for c in _WAV.split(", ")]
    for batch in batches:
        rows = []
        for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist()):
            store, place = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
            with store.open_input_file(place) as f:

                def read(at: int, n: int) -> bytes:
                    return f.read_at(max(0, min(n, size - at)), at) if at < size else b""

                rows.append((path, size, *(wav_format(read, size) or (None,) * 5)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)


def wav_header_scan(spark: SparkSession, path: str) -> DataFrame:
    """(relative_path, duration_sec, sample_rate_hz, channels, bit_depth, format, bytes, error_code) of the WAV files
    below a path, whatever chunks stand before their data; anything else has error_code INPUT_UNREADABLE and nulls. Only
    headers are read. Spark's listing leaves out files without bytes."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    f = listed.mapInArrow(_headers, _WAV)
    frame = F.col("channels") * F.col("bit_depth") / 8
    ok = F.col("sample_rate_hz").isNotNull()
    return f.select(
        F.element_at(F.split("path", "/"), -1).alias("relative_path"), F.when(F.col("sample_rate_hz") > 0, F.col("data_bytes") / F.nullif(frame, F.lit(0.0)) / F.col("sample_rate_hz")).alias("duration_sec"),
        "sample_rate_hz", "channels", "bit_depth", "format", "bytes", F.when(~ok, "INPUT_UNREADABLE").alias("error_code"),
    )


def write_manifest(df: DataFrame, path: str) -> None:
    """CSV with a header in the columns' order, each file starting with a byte order mark."""
    marked = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    marked.write.option("header", "true").mode("overwrite").csv(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; a byte order mark before the first value or name is dropped."""
    fields = T.StructType.fromDDL(schema).fields
    raw = spark.read.option("header", "true").csv(path)
    clean = lambda c: F.regexp_replace(F.col(f"`{c}`"), "^﻿", "")
    return raw.select(*(clean(c).cast(f.dataType).alias(f.name) for c, f in zip(raw.columns, fields)))


def explode_labels(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """(keep, variant, label, value): rows of a column of nested JSON {variant: {label: number}}."""
    outer = F.from_json(json_col, "map<string, map<string, double>>")
    v = df.select(*keep, F.explode(outer).alias("variant", "labels"))
    return v.select(*keep, "variant", F.explode("labels").alias("label", "value"))


def read_label_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", "true").schema(schema).json(path)


def write_documents(df: DataFrame, path: str, column: str = "document") -> None:
    """A JSON document or report line a row."""
    df.select(column).write.mode("overwrite").text(path)
