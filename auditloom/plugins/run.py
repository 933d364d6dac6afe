"""Plug-in functions run over volume files in Python workers: embedding, radiomics, shape and registration (O-121 to O-134).

A plug-in is named in a registry by a factory, which each worker calls once. Networks are ONNX files; none is shipped, and
registration has a stand-in that only moves centroids onto each other.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators import volumes
from auditloom.sources import nifti, tables

#: Factories by name: an embedder maps (image, mask) in (rows, columns, slices) to vectors by mode or none,
#: a radiomics extractor maps an image (z, y, x) and its spacing to a vector, a registrar maps (fixed, moving, moving mask, spacings) to the mask on the fixed grid.
EMBEDDERS: dict[str, Callable[[], Callable]] = {}
RADIOMICS: dict[str, Callable[[], Callable]] = {}
REGISTRARS: dict[str, Callable[[], Callable]] = {}


@lru_cache(16)
def _made(factory: Callable[[], Callable]) -> Callable:
    return factory()


def onnx_network(path: str, mean: tuple[float, ...] = (0.485, 0.456, 0.406), sd: tuple[float, ...] = (0.229, 0.224, 0.225), side: int | None = 224) -> Callable[[np.ndarray], np.ndarray]:
    """The token function of an ONNX network, loaded on its first use in a worker (O-124, O-125, O-127, O-128).

    Pictures (side x side x 3 bytes) are stretched and normalised as the network's description says; volumes go in as they are.
    """
    import onnxruntime

    session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
    name = session.get_inputs()[0].name

    def tokens(x: np.ndarray) -> np.ndarray:
        if x.dtype == np.uint8:
            x = np.stack([volumes.resize_trilinear(x[None, :, :, c], (1, side or x.shape[0], side or x.shape[1]))[0] for c in range(3)])
            x = ((x / 255 - np.reshape(mean, (3, 1, 1))) / np.reshape(sd, (3, 1, 1))).astype(np.float32)[None]
        return session.run(None, {name: x})[0][0]

    return tokens


def register_embedder(name: str, network: Callable[[], Callable[[np.ndarray], np.ndarray]], registers: int = 0, volume: bool = False) -> None:
    """Make a backbone of a token network: slice by slice, or of whole volumes (O-134)."""

    def factory() -> Callable:
        tokens = network()
        body = volumes.embed_volume if volume else volumes.embed_slices
        return lambda image, mask: body(tokens, image, mask, registers)

    EMBEDDERS[name] = factory


def centroid_shift(fixed: np.ndarray, moving: np.ndarray, mask: np.ndarray, spacing: tuple, moving_spacing: tuple) -> np.ndarray:
    """A stand-in for registration: the moving mask, its image's centre of brightness moved onto the fixed one's, on the fixed grid."""

    def centre(x: np.ndarray) -> np.ndarray:
        w = x - x.min()
        total = w.sum()
        return np.array([(w.sum(tuple(a for a in range(3) if a != k)) * np.arange(n)).sum() / total if total else (n - 1) / 2 for k, n in enumerate(x.shape)])

    ratio = np.asarray(spacing) / np.asarray(moving_spacing)
    shift = centre(moving) - centre(fixed) * ratio
    matrices = [volumes._samples(m, n, r, s, 0, False) for m, n, r, s in zip(mask.shape, fixed.shape, ratio, shift, strict=True)]
    return volumes.along_axes(mask, matrices) > 0


REGISTRARS["centroid_shift"] = lambda: centroid_shift


def with_content(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the bytes of the files that path columns name; ``columns`` maps a path column to its new column."""
    spark = rows.sparkSession
    for path, name in columns.items():
        wanted = [r[0] for r in rows.select(path).distinct().collect()]  # paths, not volumes; read lists them anyway
        files = spark.read.format("binaryFile").load(wanted).select(F.col("path").alias(path), F.col("content").alias(name)) if wanted else spark.createDataFrame([], f"{path} string, {name} binary")
        rows = rows.join(files, path)
    return rows


def _halves(row, image: np.ndarray, mask: np.ndarray | None, axis: int | None) -> tuple[np.ndarray, np.ndarray | None]:
    if row.side is None or axis is None:
        return image, mask
    cut = [None if v is None else volumes.half(v, axis, row.side) for v in (image, mask)]
    if getattr(row, "flipped", False):
        cut = [None if v is None else np.flip(v, axis) for v in cut]
    return cut[0], cut[1]


def embed_cases(cases: DataFrame, backbone: str, split_axis: int = 0, factory: Callable | None = None) -> DataFrame:
    """An embedding bank of ``cases`` (as ``assembly.site_cases`` with contents ``image``, ``mask``); empty masks give no rows where the backbone needs one (O-130)."""
    factory, axis = factory or EMBEDDERS[backbone], volumes.hwd_axis(split_axis)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = _made(factory)
        for part in parts:
            out = []
            for row in part.itertuples():
                image, spacing = nifti.decode(row.image)
                pair = volumes.volume_pair(image, nifti.decode(row.mask)[0], spacing)
                found = embed(*_halves(row, *pair, axis)) or {}
                out += [(backbone, m, row.site, row.case_id, np.asarray(v, np.float32)) for m, v in found.items()]
            yield pd.DataFrame(out, columns=["backbone", "mode", "site", "case_id", "embedding"], dtype=object)

    return cases.select("site", "case_id", "side", "flipped", "image", "mask").mapInPandas(run, tables.EMBEDDINGS)


def shape_of_cases(cases: DataFrame, split_axis: int = 0) -> DataFrame:
    """``case_id, site`` and the 14 shape features of every case whose mask has a shape (O-122).

    Masks that are empty, a single voxel or a line give no row. Volumes are brought to 1 mm first, halves are not mirrored.
    """
    axis = volumes.zyx_axis(split_axis)
    names = sorted(volumes.shape_features(np.ones((2, 2, 2))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples():
                mask, spacing = nifti.decode(row.mask)
                mask = volumes.resample((mask > 0).astype(np.uint8), spacing, 1.0, 0)
                own = spacing if volumes.close(spacing) else (1.0,) * 3
                if row.side is not None:
                    mask = volumes.half(mask, axis, row.side)
                try:
                    found = volumes.shape_features(mask, own)
                except ValueError:
                    found = None
                if found:
                    out.append((row.case_id, row.site, *[found[n] for n in names]))
            yield pd.DataFrame(out, columns=["case_id", "site", *names], dtype=object)

    return cases.select("site", "case_id", "side", "mask").mapInPandas(run, "case_id string, site string, " + ", ".join(f"{n} double" for n in names))


def radiomics_of_cases(images: DataFrame, extractor: str, split_axis: int = 0) -> DataFrame:
    """Whole-image features at 1 mm in long form, ``case_id, site, feature, value`` (O-123)."""
    factory, axis = RADIOMICS[extractor], volumes.zyx_axis(split_axis)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = _made(factory)
        for part in parts:
            out = []
            for row in part.itertuples():
                image, spacing = nifti.decode(row.image)
                image = volumes.resample(image.astype(np.float64), spacing)
                values = extract(_halves(row, image, None, axis)[0], spacing if volumes.close(spacing) else (1.0,) * 3)
                out += [(row.case_id, row.site, f"f{i:05d}", float(v)) for i, v in enumerate(values)]
            yield pd.DataFrame(out, columns=["case_id", "site", "feature", "value"], dtype=object)

    return images.select("site", "case_id", "side", "image").mapInPandas(run, "case_id string, site string, feature string, value double")


def register_pairs(pairs: DataFrame, registrar: str = "centroid_shift") -> DataFrame:
    """``site, case_id, ref_case_id, dsc, reg_seconds`` of query and reference volumes (O-131 to O-133).

    ``pairs``: contents ``image``, ``mask`` of the query and ``ref_image``, ``ref_mask`` of the reference. The reference's label 1 is
    warped onto the query; Dice is null where either mask is empty or the registration failed.
    """
    factory = REGISTRARS[registrar]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        register = _made(factory)
        for part in parts:
            out = []
            for row in part.itertuples():
                began = time.monotonic()
                (fixed, spacing), (moving, moving_spacing) = nifti.decode(row.image), nifti.decode(row.ref_image)
                mask, label = (nifti.decode(x)[0].astype(np.int16) == 1 for x in (row.mask, row.ref_mask))
                try:
                    warped = register(fixed.astype(np.float64), moving.astype(np.float64), label.astype(np.float64), spacing, moving_spacing)
                except Exception:  # noqa: BLE001  a failed registration is a result, not a failed task
                    warped = None
                dsc = None
                if warped is not None and mask.any() and warped.any():
                    dsc = 2.0 * float((mask & warped).sum()) / float(mask.sum() + warped.sum())
                out.append((row.site, row.case_id, row.ref_case_id, dsc, time.monotonic() - began))
            yield pd.DataFrame(out, columns=["site", "case_id", "ref_case_id", "dsc", "reg_seconds"], dtype=object)

    return pairs.select("site", "case_id", "ref_case_id", "image", "mask", "ref_image", "ref_mask").mapInPandas(run, tables.REGISTRATIONS)


def atlas_scores(registrations: DataFrame) -> DataFrame:
    """The Atlas-RCA score, minus the best Dice with any reference; cases without a valid one have no row (O-56)."""
    from auditloom.functions.columns import missing_to_null

    best = registrations.groupBy("case_id", "site").agg(F.max(missing_to_null(F.col("dsc"))).alias("best")).where("best is not null")
    return best.select("case_id", "site", F.lit("atlas_rca").alias("method"), (-F.col("best")).alias("score"))
