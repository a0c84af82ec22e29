"""fvecs and ivecs files: records of a little-endian int32 length and as many float32 or int32 values."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes after which ``write_vecs`` begins another file, and how its files' names begin.
FILE_BYTES, PREFIX = 16 << 20, "first-"


def parse(data: bytes, kind: str) -> np.ndarray:
    """All records (n, dim); they have the same length, and the file ends with one."""
    raw = np.frombuffer(data, "<i4") if len(data) % 4 == 0 else None
    if raw is None:
        raise ValueError("the file ends within a value")
    if not len(raw):
        return np.zeros((0, 0), "<f4" if kind == "fvecs" else "<i4")
    dim = int(raw[0])
    if dim < 1 or len(raw) % (dim + 1):
        raise ValueError(f"a length of {dim} doesn't fit the file")
    rows = raw.reshape(-1, dim + 1)
    if (rows[:, 0] != dim).any():
        raise ValueError("records have different lengths")
    body = np.ascontiguousarray(rows[:, 1:])
    return body.view("<f4") if kind == "fvecs" else body


def read_vecs(spark: SparkSession, path: str, kind: str = "fvecs", budget: int | None = None) -> DataFrame:
    """(path, position, v) of every record of the files at ``path``; files over ``budget`` bytes are refused before they are read.

    A position counts from the start of the file, or of the folder that ``write_vecs`` has written.  A file is read
    by one task, and has to be smaller than 2 GB; large sets come as many files.
    """
    item = "float" if kind == "fvecs" else "int"
    files = spark.read.format("binaryFile").load(path)
    if budget is not None and (over := files.where(F.col("length") > budget).select("path", "length").first()):
        raise ValueError(f"{over.path} has {over.length} bytes, over the budget of {budget}")
    files = files.select("path", "length", "content")

    def run(batches):
        for batch in batches:
            for name, _, content in batch.itertuples(index=False):
                v = parse(content, kind)
                if kind == "fvecs" and not np.isfinite(v).all():
                    raise ValueError(f"{name} has values that are not finite")
                found = re.search(rf"/{PREFIX}(\d{{20}})\.fvecs$", name)
                first = int(found[1]) if found else 0
                for i in range(0, len(v), 4096):
                    yield pd.DataFrame({"path": name, "position": first + np.arange(i, min(i + 4096, len(v))), "v": list(v[i : i + 4096])})

    return files.mapInPandas(run, f"path string, position long, v array<{item}>")


def write_vecs(df: DataFrame, column: str, path: str) -> None:
    """A new folder of fvecs files with the rows in the order of the DataFrame, each file named by the position of its first row.

    Tasks write their own rows where all executors see them (pyarrow's file systems),
    at most FILE_BYTES or one batch more to a file, so that the driver holds names only.
    """
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(place):
        raise ValueError(f"{path} is there already")
    fs.mkdirs(place)
    uri = re.sub(r"^file:/+", "file:///", fs.makeQualified(place).toString())

    def run(batches):
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        store, folder = FileSystem.from_uri(uri)
        part, nth, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                name, rows, size = f"_{uuid.uuid4().hex}", 0, 0
                out = store.open_output_stream(f"{folder}/{name}")
            data = b"".join(map(_record, batch.v))
            out.write(data)
            rows, size = rows + len(batch), size + len(data)
            if size >= FILE_BYTES:
                out.close()
                yield pd.DataFrame({"part": [part], "nth": [nth], "name": [name], "n": [rows]})
                nth, out = nth + 1, None
        if out is not None:
            out.close()
            yield pd.DataFrame({"part": [part], "nth": [nth], "name": [name], "n": [rows]})

    first = 0
    for made in sorted(df.select(F.col(column).alias("v")).mapInPandas(run, "part int, nth int, name string, n long").collect()):
        new = spark._jvm.org.apache.hadoop.fs.Path(place, f"{PREFIX}{first:020d}.fvecs")
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(place, made.name), new):
            raise OSError(f"{made.name} can't be renamed in {path}")
        first += made.n


def _record(v) -> bytes:
    if v is None or not len(v):
        raise ValueError("a null or empty vector has no record")
    return np.int32(len(v)).astype("<i4").tobytes() + np.asarray(v, "<f4").tobytes()
