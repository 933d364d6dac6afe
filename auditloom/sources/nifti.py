"""Volumes in NIfTI-1 files: listing, decoding in Arrow batches, and sparse masks."""

from __future__ import annotations

import gzip
import posixpath
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.sources.tables import exists

#: Sample types of the format, by their code.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def _plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def decode(data: bytes) -> tuple[np.ndarray, tuple[float, ...]]:
    """Voxels in the order (z, y, x) with the file's scaling applied, and the spacing in the same order."""
    data = _plain(data)
    if len(data) < 348:
        raise ValueError("truncated volume header")
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", data[:4])[0] != 348:
        raise ValueError("not a volume file")
    dims = struct.unpack(order + "8h", data[40:56])
    code = struct.unpack(order + "h", data[70:72])[0]
    if code not in TYPES:
        raise ValueError(f"sample type {code} is not supported")
    pixdim = struct.unpack(order + "8f", data[76:108])
    start, slope, shift = struct.unpack(order + "3f", data[108:120])
    shape = [max(1, d) for d in dims[1:4]]
    found = np.frombuffer(data, np.dtype(TYPES[code]).newbyteorder(order), int(np.prod(shape)), int(start)).reshape(shape[::-1])
    if slope not in (0.0, 1.0) or shift and slope:
        found = found.astype(np.float64) * slope + shift
    return found, tuple(abs(float(s)) or 1.0 for s in pixdim[3:0:-1])


class Geometry(NamedTuple):
    """Where a volume lies, per axis in the order (x, y, z); ``direction`` is row-major 3 x 3."""

    shape: tuple[int, ...]
    spacing: tuple[float, ...]
    origin: tuple[float, ...]
    direction: tuple[float, ...]


def geometry(data: bytes) -> Geometry:
    """Shape, spacing, origin and direction of a volume file: of its affine rows if it has them, else of its spacing alone."""
    data = _plain(data)
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    shape = tuple(max(1, d) for d in struct.unpack(order + "8h", data[40:56])[1:4])
    spacing = tuple(abs(s) or 1.0 for s in struct.unpack(order + "8f", data[76:108])[1:4])
    rows = np.array(struct.unpack(order + "12f", data[280:328])).reshape(3, 4)
    if struct.unpack(order + "h", data[254:256])[0] <= 0:
        return Geometry(shape, spacing, (0.0, 0.0, 0.0), tuple(np.eye(3).ravel()))
    lengths = np.linalg.norm(rows[:, :3], axis=0)
    lengths[lengths == 0] = 1.0
    return Geometry(shape, tuple(map(float, lengths)), tuple(map(float, rows[:, 3])), tuple(map(float, (rows[:, :3] / lengths).ravel())))


def encode(volume: np.ndarray, spacing: tuple[float, ...] = (1.0, 1.0, 1.0), origin: tuple[float, ...] = (0.0, 0.0, 0.0), direction: tuple[float, ...] = (1, 0, 0, 0, 1, 0, 0, 0, 1)) -> bytes:
    """A gzipped single-file volume of ``volume`` (z, y, x), spacing in the same order, origin and direction in (x, y, z); the same bytes for the same input."""
    codes = {np.dtype(t): c for c, t in TYPES.items()}
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, volume.ndim, *volume.shape[::-1], *[1] * (7 - volume.ndim))
    struct.pack_into("<2h", head, 70, codes[volume.dtype], volume.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *spacing[::-1], *[1.0] * (7 - len(spacing)))
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    if volume.ndim == 3:
        affine = np.column_stack([np.reshape(direction, (3, 3)) * np.asarray(spacing[::-1], float), origin])
        struct.pack_into("<2h", head, 252, 0, 1)
        struct.pack_into("<12f", head, 280, *affine.ravel())
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + np.ascontiguousarray(volume).tobytes(), mtime=0)


def half_geometry(shape: Column, spacing: Column, origin: Column, axis: int, side: Column) -> tuple[Column, Column]:
    """Shape and origin of a half along an axis (x, y, z): the right one begins in the middle and takes the extra slab (O-22).

    The origin moves along the axis by whole voxels, whatever the direction is; spacing and direction stay.
    """
    size, right = F.element_at(shape, axis + 1), side == "R"
    mid = F.floor(size / 2).cast("int")
    at = lambda i, new, old: F.when(i == axis, new).otherwise(old)
    shapes = F.transform(shape, lambda n, i: at(i, F.when(right, size - mid).otherwise(mid), n))
    return shapes, F.transform(origin, lambda o, i: at(i, o + F.when(right, mid * F.element_at(spacing, axis + 1)).otherwise(0.0), o))


def write_files(files: DataFrame) -> DataFrame:
    """Write ``path, content`` from the executors into a shared store and return ``path, size`` of what was written (O-21 to O-23).

    A file is written anew under a name of its own and then moved, so a task that runs twice leaves one whole file.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes = []
            for path, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                store, place = pafs.FileSystem.from_uri(path)
                store.create_dir(posixpath.dirname(place), recursive=True)
                own = f"{posixpath.dirname(place)}/.{uuid.uuid4().hex}"
                data = content.as_py()
                with store.open_output_stream(own) as out:
                    out.write(data)
                store.move(own, place)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64())], names=["path", "size"])

    return files.select("path", "content").mapInArrow(run, "path string, size bigint")


def binarised(masks: DataFrame) -> DataFrame:
    """``path, content`` of masks (``path, content`` files) with every label above zero made one, in type and place as before; empty masks go (O-23)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                data = content.as_py()
                volume, where = decode(data)[0], geometry(data)
                if (volume > 0).any():
                    made = encode((volume > 0).astype(volume.dtype.newbyteorder("=")), where.spacing[::-1], where.origin, where.direction)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([made], pa.binary())], names=["path", "content"])

    return masks.select("path", "content").mapInArrow(run, "path string, content binary")


def vote_files(masks: DataFrame, done: DataFrame, folder: str, threshold: int = 3) -> DataFrame:
    """``path, content`` of the vote masks still missing in ``folder`` (O-21, O-48).

    ``masks``: ``site, case_id, fold, content`` of every prediction; ``done``: ``site, case_id`` of those written
    before. A case's folds, a handful of masks, meet in one task; the first one's geometry is kept. A case with a single
    mask passes through; one whose masks don't allow a vote has no row.
    """

    def vote(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fold")
        contents = [bytes(c) for c in rows["content"]]
        made = contents[0]
        if len(contents) > 1:
            first, where = decode(contents[0])[0], geometry(contents[0])
            same = [v for v in (first, *(decode(c)[0] for c in contents[1:])) if v.shape == first.shape]
            if len(same) < 2:
                return pd.DataFrame({"path": [], "content": []}, dtype=object)
            voted = (sum((v > 0).astype(np.uint8) for v in same) >= threshold).astype(np.uint8)
            made = encode(voted, where.spacing[::-1], where.origin, where.direction)
        name = f"{rows['site'].iloc[0]}_{rows['case_id'].iloc[0]}_mv.nii.gz"
        return pd.DataFrame({"path": [f"{folder.rstrip('/')}/{name}"], "content": [made]}, dtype=object)

    todo = masks.join(done.select("site", "case_id"), ["site", "case_id"], "left_anti")
    return todo.groupBy("site", "case_id").applyInPandas(vote, "path string, content binary")


def list_volumes(spark: SparkSession, folder: str, pattern: str = "*_0000.nii.gz") -> DataFrame:
    """``path, file, dir`` of the volumes below a folder; their content is only read if asked for (O-04, O-05)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.element_at(F.split("path", "/"), -2).alias("dir"))


def prefer_folder(files: DataFrame, folders: list[str], keys: list[str]) -> DataFrame:
    """Of each group of ``keys`` the files of the first of ``folders`` that has any (O-04 to O-06).

    With the site as key the choice is one per site; with the file name as key it is one per file.
    """
    rank = F.array_position(F.array(*[F.lit(f) for f in folders]), F.col("dir"))
    ranked = files.withColumn("_rank", rank).where("_rank > 0")
    best = ranked.groupBy(*keys).agg(F.min("_rank").alias("_best"))
    return ranked.join(best, keys).where("_rank = _best").drop("_rank", "_best")


def vote_file(site: Column, case_id: Column) -> Column:
    """Name of a case's majority-vote mask (O-07)."""
    return F.concat(site, F.lit("_"), case_id, F.lit("_mv.nii.gz"))


def read_masks(spark: SparkSession, folder: str, pattern: str = "*.nii.gz") -> DataFrame:
    """Foreground voxels of the masks below a folder: ``path, shape, spacing, z, y, x, label``; one row per voxel above zero (O-11).

    A file is decoded by one task, and its foreground leaves in slabs, so a batch never holds more than one slice. A
    mask without foreground has no rows; a damaged file fails the read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, data in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                volume, spacing = decode(data.as_py())
                if volume.ndim != 3:
                    raise ValueError(f"{path}: a mask has three axes")
                for z, plane in enumerate(volume):
                    y, x = np.nonzero(plane > 0)
                    n = len(x)
                    if n:
                        columns = [pa.array([path] * n), pa.array([list(volume.shape)] * n, pa.list_(pa.int32())), pa.array([list(spacing)] * n, pa.list_(pa.float64()))]
                        columns += [pa.array(np.full(n, z, np.int32)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(plane[y, x].astype(np.float64))]
                        yield pa.RecordBatch.from_arrays(columns, names=["path", "shape", "spacing", "z", "y", "x", "label"])

    return files.select("path", "content").mapInArrow(run, "path string, shape array<int>, spacing array<double>, z int, y int, x int, label double")


def read_geometry(spark: SparkSession, folder: str, pattern: str = "*.nii.gz") -> DataFrame:
    """``path, shape, spacing, origin, direction`` of every volume below a folder, an empty mask's too (O-11)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, data in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                g = geometry(data.as_py())
                yield pa.RecordBatch.from_pylist([{"path": path, "shape": list(g.shape), "spacing": list(g.spacing), "origin": list(g.origin), "direction": list(g.direction)}], schema=_GEOMETRY)

    return files.select("path", "content").mapInArrow(run, "path string, shape array<int>, spacing array<double>, origin array<double>, direction array<double>")


_GEOMETRY = pa.schema([("path", pa.string()), ("shape", pa.list_(pa.int32())), *[(n, pa.list_(pa.float64())) for n in ("spacing", "origin", "direction")]])


def prefer_extension(files: DataFrame, keys: list[str]) -> DataFrame:
    """One file per key: the compressed one if both are there (O-52)."""
    plain = F.when(F.col("file").endswith(".nii.gz"), 0).when(F.col("file").endswith(".nii"), 1)
    best = files.withColumn("_plain", plain).where("_plain is not null").groupBy(*keys).agg(F.min(F.struct("_plain", "file", "path")).alias("_best"))
    return best.select(*keys, "_best.file", "_best.path")


def fold_membership(texts: DataFrame, tasks: DataFrame, reference_site: str) -> DataFrame:
    """``case_id, fold`` of the reference site from the folds' metric files; the last fold by name wins (O-10, O-112).

    ``texts``: ``fold string, value string`` with one whole JSON file per row; ``tasks``: ``task, site``. Of a file's epochs
    only the last by name counts. Files that do not parse and tasks without a site give no rows.
    """
    epochs = F.from_json("value", "map<string, map<string, map<string, string>>>")
    last = texts.select("fold", epochs.alias("epochs")).where(F.size("epochs") > 0)
    last = last.select("fold", F.element_at("epochs", F.array_max(F.map_keys("epochs"))).alias("tasks"))
    named = last.select("fold", F.explode("tasks").alias("task", "cases")).join(tasks, "task").where(F.col("site") == reference_site)
    return named.select("fold", F.explode(F.map_keys("cases")).alias("case_id")).groupBy("case_id").agg(F.max("fold").alias("fold"))


def read_fold_files(spark: SparkSession, pred_root: str, folds: list[str], name: str) -> tuple[DataFrame, list[str]]:
    """``fold, value`` of the folds' metric files, and the folds that have none (O-10)."""
    have = [f for f in folds if exists(spark, f"{pred_root}/{f}/{name}")]
    empty = spark.createDataFrame([], "fold string, value string")
    if have:
        texts = spark.read.text([f"{pred_root}/{f}/{name}" for f in have], wholetext=True)
        empty = texts.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - name.count("/") - 1).alias("fold"), "value")
    return empty, [f for f in folds if f not in have]
