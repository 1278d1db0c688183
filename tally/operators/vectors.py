"""Vector and pixel-array operators.

Per-element work uses Spark's higher-order array functions (``transform``,
``zip_with``, ``aggregate``) so it stays inside generated code. Resampling and
augmentation need neighbourhood arithmetic over a whole image or volume; those
run in ``applyInPandas`` / ``mapInArrow`` with NumPy, one image or one study
per call, so the work is spread by Spark and bounded per call.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGES = 128  # that are augmented and handed on together


def fuse_concat(left: DataFrame, right: DataFrame, on: str, lcol: str, rcol: str, out: str = "fused") -> DataFrame:
    """Join on id and concatenate two vectors (image || tabular)."""
    return left.select(on, F.col(lcol).cast("array<double>").alias("_l")).join(
        right.select(on, F.col(rcol).cast("array<double>").alias("_r")), on).select(
        on, F.concat("_l", "_r").alias(out))


def normalize_image(px: Column | str, mean: float | list[float], std: float | list[float], scale: float = 255.0) -> Column:
    """E18 (normalise part): (x / scale - mean) / std per element.

    With lists, element i belongs to channel i % len(mean) (channels lie side by side in each pixel).
    """
    c = F.col(px) if isinstance(px, str) else px
    if isinstance(mean, (int, float)):
        return F.transform(c, lambda x: (x.cast("double") / scale - mean) / std)
    if len(mean) != len(std):
        raise ValueError(f"{len(mean)} means and {len(std)} deviations")
    m, s, k = _const_array(mean), _const_array(std), len(mean)
    return F.transform(c, lambda x, i: (x.cast("double") / scale - F.element_at(m, i % k + 1)) / F.element_at(s, i % k + 1))


def to_channels(px: Column | str, channels: int = 3) -> Column:
    """A one-channel image with each pixel repeated for every channel."""
    c = F.col(px) if isinstance(px, str) else px
    return F.flatten(F.transform(c, lambda x: F.array_repeat(x, channels)))


# ---------------------------------------------------------------- E17 resampling
def _linear_axis(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Source indices and weights for linear resampling with half-pixel centres (align_corners=False)."""
    scale = n_in / n_out
    src = (np.arange(n_out) + 0.5) * scale - 0.5
    src = np.clip(src, 0, n_in - 1)
    lo = np.floor(src).astype(int)
    hi = np.minimum(lo + 1, n_in - 1)
    return lo, hi, src - lo


def _axis_sources(n_in: Column, n_out: int, j: Column) -> tuple[Column, Column, Column]:
    """Column form of ``_linear_axis``: (lo, hi, weight) for output index j (half-pixel centres)."""
    src = (j.cast("double") + 0.5) * (n_in.cast("double") / F.lit(float(n_out))) - 0.5
    src = F.least(F.greatest(src, F.lit(0.0)), (n_in - 1).cast("double"))
    lo = F.floor(src).cast("int")
    hi = F.least(lo + 1, n_in - 1)
    return lo, hi, src - lo


def resize_volumes_long(volumes: DataFrame, study: str, z: str, plane: str, side: int, size: int,
                        clip: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """E17, distributed form: trilinear resize to size^3 without gathering a study.

    Resizing is separable. Output slice j of a study needs only source slices
    lo(j) and hi(j): an equi-join on (study, z) fetches the two planes, they are
    blended, and the in-plane bilinear resample is a ``transform`` over output
    pixels (JVM side). Work is spread by (study, output slice), so a study with
    many slices is not one task. Output: (study, z, plane array<double> of size^2).
    """
    depth = volumes.groupBy(study).agg(F.count(F.lit(1)).alias("_d"))
    out = depth.select(study, "_d", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("z_out"))
    lo, hi, w = _axis_sources(F.col("_d"), size, F.col("z_out"))
    out = out.select(study, "z_out", lo.alias("_zlo"), hi.alias("_zhi"), w.alias("_wz"))
    planes = volumes.select(study, F.col(z).alias("_z"), F.col(plane).alias("_p"))
    a = planes.withColumnRenamed("_z", "_zlo").withColumnRenamed("_p", "_plo")
    b = planes.withColumnRenamed("_z", "_zhi").withColumnRenamed("_p", "_phi")
    j = out.join(a, [study, "_zlo"]).join(b, [study, "_zhi"])
    blended = F.zip_with("_plo", "_phi", lambda p, q: p * (1 - F.col("_wz")) + q * F.col("_wz"))
    j = j.select(study, "z_out", blended.alias("_b"))
    return j.select(study, F.col("z_out").alias(z), plane_resample("_b", side, size, clip).alias(plane))


def plane_tables(side: int, size: int) -> tuple[list[list[int]], list[list[float]]]:
    """Bilinear sampling of a side x side plane onto size x size (half-pixel centres).

    For output pixel k: 1-based source indices I[t][k] and weights W[t][k] of its
    four neighbours t = (lo,lo), (lo,hi), (hi,lo), (hi,hi) in (row, column).
    """
    lo_r, hi_r, w_r = _linear_axis(side, size)
    idx: list[list[int]] = [[], [], [], []]
    wts: list[list[float]] = [[], [], [], []]
    for r in range(size):
        for c in range(size):
            for t, (rr, cc, wgt) in enumerate(((lo_r[r], lo_r[c], (1 - w_r[r]) * (1 - w_r[c])),
                                                (lo_r[r], hi_r[c], (1 - w_r[r]) * w_r[c]),
                                                (hi_r[r], lo_r[c], w_r[r] * (1 - w_r[c])),
                                                (hi_r[r], hi_r[c], w_r[r] * w_r[c]))):
                idx[t].append(int(rr) * side + int(cc) + 1)
                wts[t].append(float(wgt))
    return idx, wts


def plane_resample(px: Column | str, side: int, size: int, clip: tuple[float, float] | None = None) -> Column:
    """Bilinear resample of one flattened plane; the sampling tables are constants (JVM side)."""
    c = F.col(px) if isinstance(px, str) else px
    idx, wts = plane_tables(side, size)
    I = [_const_int_array(v) for v in idx]
    W = [_const_array(v) for v in wts]

    def pixel(k: Column) -> Column:
        k1 = k + 1
        v = F.lit(0.0)
        for t in range(4):
            v = v + F.element_at(c, F.element_at(I[t], k1)).cast("double") * F.element_at(W[t], k1)
        return F.least(F.greatest(v, F.lit(clip[0])), F.lit(clip[1])) if clip else v

    return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), pixel)


def resize_images(df: DataFrame, id_col: str, px: str, side: int, size: int) -> DataFrame:
    """E18 (resize part): square one-channel images side x side -> size x size, bilinear, in SQL."""
    return df.select(id_col, plane_resample(px, side, size).alias("resized"))


# ---------------------------------------------------------------- E19 augmentation
def _rng(seed: int, key: int, epoch: int) -> np.random.Generator:
    return np.random.default_rng([seed, int(key) & 0xFFFFFFFF, epoch])


def _rotate(img: np.ndarray, deg: float) -> np.ndarray:
    """Rotate about the centre with bilinear sampling; outside, the image is mirrored at its border pixels."""
    h, w = img.shape[:2]
    t = math.radians(deg)
    yy, xx = np.mgrid[0:h, 0:w].astype(np.float64)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sy = math.cos(t) * (yy - cy) + math.sin(t) * (xx - cx) + cy
    sx = -math.sin(t) * (yy - cy) + math.cos(t) * (xx - cx) + cx
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    out = np.zeros(img.shape, np.float64)
    for dy in (0, 1):
        for dx in (0, 1):
            yi, xi = y0 + dy, x0 + dx
            wgt = (1 - np.abs(sy - yi)) * (1 - np.abs(sx - xi))
            out += wgt.reshape(h, w, *[1] * (img.ndim - 2)) * img[_mirror(yi, h), _mirror(xi, w)]
    return out


def _mirror(at: np.ndarray, n: int) -> np.ndarray:
    """Index of the mirrored position (the border pixel is not repeated)."""
    if n == 1:
        return np.zeros_like(at)
    at = np.abs(at) % (2 * n - 2)
    return np.minimum(at, 2 * n - 2 - at)


# Probabilities and ranges of the reference's training transforms (noise variance on a scale of 0-255,
# sides of the holes in pixels up to a tenth of the image).
FLIP, ROTATE, LIGHT, NOISE, HOLES = 0.5, 0.5, 0.5, 0.3, 0.3
DEGREES, CHANGE, VARIANCE, HOLE_NUMBER, HOLE_LEAST, HOLE_SHARE = 15, 0.2, (10.0, 50.0), (4, 8), 8, 10


def augment_one(img: np.ndarray, rng: np.random.Generator, top: float = 255.0) -> np.ndarray:
    """Flip, rotation, brightness and contrast, Gaussian noise and coarse dropout of an image, each with its probability.

    ``img`` has height, width and perhaps channels, values from 0 to ``top`` (results are clipped to that). A hole's
    sides are drawn from 8 pixels to a tenth of the image, 8 where that is less, and never exceed the image.
    """
    out = img.astype(np.float64)
    if rng.random() < FLIP:
        out = out[:, ::-1]
    if rng.random() < ROTATE:
        out = _rotate(out, rng.uniform(-DEGREES, DEGREES))
    if rng.random() < LIGHT:
        contrast, light = rng.uniform(-CHANGE, CHANGE, 2)
        out = np.clip(out * (1 + contrast) + light * top, 0, top)
    if rng.random() < NOISE:
        sigma = math.sqrt(rng.uniform(*VARIANCE)) * top / 255
        out = np.clip(out + rng.normal(0, sigma, out.shape), 0, top)
    if rng.random() < HOLES:
        out = out.copy()
        size = out.shape[:2]
        for _ in range(int(rng.integers(HOLE_NUMBER[0], HOLE_NUMBER[1] + 1))):
            hole = [min(n, int(rng.integers(HOLE_LEAST, max(HOLE_LEAST, n // HOLE_SHARE) + 1))) for n in size]
            y, x = (int(rng.integers(0, n - k + 1)) for n, k in zip(size, hole))
            out[y:y + hole[0], x:x + hole[1]] = 0
    return np.ascontiguousarray(out)


def augment_images(df: DataFrame, id_col: str, px: str, side: int, seed: int, epoch: int = 0, channels: int = 1, top: float = 255.0) -> DataFrame:
    """Seeded random augmentation; the RNG depends on (seed, id, epoch) only, not on partitioning."""
    shape = (side, side) if channels == 1 else (side, side, channels)

    def per_batch(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, IMAGES):
                ids, images = (batch.column(c).slice(a, IMAGES) for c in (id_col, px))
                out = [augment_one(np.asarray(p.values, dtype=np.float64).reshape(shape), _rng(seed, i.as_py(), epoch), top).ravel() for i, p in zip(ids, images)]
                ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate(out))], [id_col, "augmented"])

    return df.select(id_col, px).mapInArrow(per_batch, f"{id_col} long, augmented array<double>")


# ---------------------------------------------------------------- E20 kernel features
def rff_params(dim: int, n_features: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random Fourier feature parameters for the RBF kernel exp(-gamma ||x - y||^2)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), size=(n_features, dim))
    b = rng.uniform(0, 2 * math.pi, size=n_features)
    return w, b


def _const_int_array(values) -> Column:
    import json
    return F.from_json(F.lit(json.dumps([int(v) for v in values])), "array<int>")


def _const_array(values) -> Column:
    """A double-array constant as ONE literal (JSON parsed at plan time by constant folding)."""
    import json
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def rbf_features(x: Column | str, dim: int, n_features: int = 64, gamma: float = 1.0, seed: int = 0) -> Column:
    """z(x) = sqrt(2/D) cos(W x + b) — random Fourier features (Rahimi & Recht 2007).

    W (D x dim) and b are one constant array each; the per-row work is a
    ``transform`` over feature indices with ``dim`` multiply-adds per feature.
    """
    w, b = rff_params(dim, n_features, gamma, seed)
    c = F.col(x) if isinstance(x, str) else x
    wl, bl = _const_array(w.ravel()), _const_array(b)
    scale = math.sqrt(2.0 / n_features)

    def feature(k):
        dot = F.element_at(bl, k + 1)
        for j in range(dim):
            dot = dot + F.element_at(wl, k * dim + (j + 1)) * c[j]
        return F.cos(dot) * F.lit(scale)

    return F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), feature)


def sketch_params(dim: int, n_out: int, degree: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places 0..n_out-1 and signs of every component in each of ``degree`` count sketches."""
    rng = np.random.default_rng([seed, dim, n_out])
    return rng.integers(0, n_out, (degree, dim)), rng.choice([-1.0, 1.0], (degree, dim))


def tensor_sketch(df: DataFrame, col: str, dim: int, n_out: int = 256, degree: int = 3, gamma: float = 1.0, coef0: float = 0.0,
                  seed: int = 0, out: str = "sketch") -> DataFrame:
    """E20 (polynomial kernel): vectors whose inner products estimate (gamma x'z + coef0)^degree (Pham & Pagh 2013).

    The count sketch of a tensor power is the circular convolution of count sketches of the
    vector, a product of their Fourier transforms: ``n_out`` numbers whatever the dimension
    and degree. A NULL vector gives NULL, other lengths than ``dim`` raise.
    """
    at, sign = sketch_params(dim + 1, n_out, degree, seed)  # the last component is sqrt(coef0)
    root, scale = math.sqrt(coef0), math.sqrt(gamma)
    rows, keep = df.withColumn("_x", F.col(col).cast("array<double>")), df.columns

    def sketches(batches):
        for batch in batches:
            column = batch.column("_x")
            has = np.array([v is not None for v in column.to_pylist()], bool)
            x = column.drop_null().flatten().to_numpy(zero_copy_only=False)
            if len(x) != has.sum() * dim or (np.diff(column.drop_null().offsets.to_numpy()) != dim).any():
                raise ValueError(f"{col}: vectors must have {dim} components")
            x = np.hstack([x.reshape(-1, dim) * scale, np.full((int(has.sum()), 1), root)])
            product = np.ones((len(x), n_out // 2 + 1), complex)
            for places, signs in zip(at, sign, strict=True):
                counts = np.zeros((len(x), n_out))
                for j in range(dim + 1):
                    counts[:, places[j]] += signs[j] * x[:, j]
                product *= np.fft.rfft(counts)
            found = np.fft.irfft(product, n_out)
            ends = np.concatenate([[0], np.cumsum(has * n_out)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()), mask=pa.array(~has))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, out])

    return rows.mapInArrow(sketches, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))
