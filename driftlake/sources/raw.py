"""Headerless planes: files of little-endian pixels whose size is known."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

KINDS = {"uint8": "u1", "uint16": "<u2", "int16": "<i2", "float32": "<f4"}
PLANE = "path string, frame int, height int, width int, pixels array<float>, status string, message string"


def scan(spark: SparkSession, folder: str, height: int, width: int, dtype: str, frames: int | None = None, pattern: str = "*.raw") -> DataFrame:
    """One row a plane; a file whose bytes are not whole planes, or not `frames` of them, is a row with its error."""
    if dtype not in KINDS:
        raise ValueError(f"unknown kind of pixels {dtype}")
    if height < 1 or width < 1:
        raise ValueError("planes have a size")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def run(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                each = height * width * np.dtype(KINDS[dtype]).itemsize
                if not data or len(data) % each or frames is not None and len(data) != frames * each:
                    want = f"{frames} planes" if frames is not None else "whole planes"
                    rows = [(path, None, None, None, None, "error", f"{len(data)} bytes are not {want} of {each}")]
                else:
                    planes = np.frombuffer(data, KINDS[dtype]).reshape(-1, height * width).astype(np.float32)
                    rows = [(path, i, height, width, p, "ok", None) for i, p in enumerate(planes)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PLANE.split(", ")])

    return files.mapInPandas(run, PLANE)
