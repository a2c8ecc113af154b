"""Raster arithmetic on whole batches of bands: numpy over the flat buffer of a list column, all bands of one size at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


@cache
def bilinear_weights(n_in: int, n_out: int) -> np.ndarray:
    """(n_out, n_in) weights of a corner-aligned resample along one axis: target i reads source i * (n_in - 1) / (n_out - 1)."""
    at = np.arange(n_out) * (n_in - 1) / max(n_out - 1, 1)
    low = np.floor(at).astype(np.int64)
    out = np.zeros((n_out, n_in))
    rows = np.arange(n_out)
    np.add.at(out, (rows, low), 1 - (at - low))
    np.add.at(out, (rows, np.minimum(low + 1, n_in - 1)), at - low)
    return out


def bilinear(stack: np.ndarray, height: int, width: int) -> np.ndarray:
    """(k, h, w) to (k, height, width), one axis after the other."""
    k, h, w = stack.shape
    if (h, w) == (height, width):
        return stack
    return bilinear_weights(h, height) @ (stack @ bilinear_weights(w, width).T)


def nearest(stack: np.ndarray, height: int, width: int) -> np.ndarray:
    """The source cell under the centre of each target cell."""
    k, h, w = stack.shape
    rows = np.floor((np.arange(height) * 2 + 1) * h / (2.0 * height)).astype(np.int64)
    cols = np.floor((np.arange(width) * 2 + 1) * w / (2.0 * width)).astype(np.int64)
    return stack[:, rows[:, None], cols[None]]


RESAMPLE = {"bilinear": bilinear, "nearest": nearest}


def zscore(bands: np.ndarray, stack: np.ndarray, stats: dict[str, tuple[float, float]]) -> np.ndarray:
    """By the band's fixed mean and deviation; a band without any by its own (population)."""
    known = np.array([stats.get(b, (np.nan, np.nan)) for b in bands], dtype=np.float64).reshape(-1, 2)
    own = np.isnan(known[:, 0])
    if own.any():
        known[own] = np.stack([stack[own].mean(axis=(1, 2)), stack[own].std(axis=(1, 2))], axis=1)
    return (stack - known[:, :1, None]) / (known[:, 1:, None] + EPS)


def minmax(stack: np.ndarray) -> np.ndarray:
    """By each band's own range; a constant band becomes 0."""
    low = stack.min(axis=(1, 2), keepdims=True)
    span = stack.max(axis=(1, 2), keepdims=True) - low
    return np.where(span > EPS, (stack - low) / np.where(span > EPS, span, 1.0), 0.0)


def clip(stack: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip(stack, low, high)


def fixed_range(bands: np.ndarray, stack: np.ndarray, ranges: dict[str, tuple[float, float]]) -> np.ndarray:
    """By the band's fixed range; a band without one by its own."""
    out = minmax(stack)
    for k, band in enumerate(bands):
        if band in ranges:
            low, high = ranges[band]
            out[k] = (stack[k] - low) / (high - low)
    return out


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 1 where b is near zero."""
    return np.where(np.abs(b) > EPS, a / np.where(np.abs(b) > EPS, b, 1.0), 1.0)


def to_db(stack: np.ndarray) -> np.ndarray:
    """Linear backscatter of a band without negative values in decibel; other bands as they are."""
    linear = (stack >= 0).all(axis=(1, 2), keepdims=True)
    return np.where(linear, 10.0 * np.log10(np.maximum(stack, 1e-10)), stack)


def stretch(stack: np.ndarray, low: float, high: float, degenerate: int = 0, eps: float = 1e-6) -> np.ndarray:
    """0..255, truncated, between two percentiles of each band (linear between closest ranks); a flat band becomes ``degenerate``."""
    flat = np.sort(stack.reshape(len(stack), -1), axis=1)

    def percentile(p: float) -> np.ndarray:
        at = (flat.shape[1] - 1) * (p / 100.0)
        k = int(np.floor(at))
        a, b = flat[:, k], flat[:, min(k + 1, flat.shape[1] - 1)]
        return (a + (b - a) * (at - k))[:, None, None]

    lo, hi = percentile(low), percentile(high)
    span = hi - lo
    scaled = np.floor((np.clip(stack, lo, hi) - lo) / np.where(span >= eps, span, 1.0) * 255.0)
    return np.where(span >= eps, scaled, float(degenerate))


def normalized_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = a + b
    return np.where(np.abs(total) > EPS, (a - b) / np.where(np.abs(total) > EPS, total, 1.0), 0.0)


def stacks(pixels: pa.Array, heights: np.ndarray, widths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, (k, h, w) array) for each size in a list column. Rows whose list does not fit their size are in none."""
    if isinstance(pixels, pa.ChunkedArray):
        pixels = pixels.combine_chunks()
    flat = pixels.flatten().to_numpy(zero_copy_only=False)
    lengths = pixels.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.cumsum(lengths) - lengths
    fits = lengths == heights.astype(np.int64) * widths
    sizes = np.stack([heights, widths], axis=1)
    for h, w in np.unique(sizes[fits], axis=0).tolist():
        rows = np.flatnonzero(fits & (heights == h) & (widths == w) & (lengths > 0))
        if len(rows):
            yield rows, flat[begins[rows][:, None] + np.arange(h * w)[None]].reshape(len(rows), h, w)


def checksum(pixels: Column) -> Column:
    """Order-sensitive sum (``arrays.checksum``) of list columns in Arrow batches; null where the list is null or holds a null."""
    def sums(lists: pa.Array) -> pa.Array:
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        cells = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(lengths)
        weighted = cells * (np.arange(len(cells)) - np.repeat(ends - lengths, lengths) + 1)
        out, some = np.zeros(len(lists)), lengths > 0
        if some.any():
            out[some] = np.add.reduceat(weighted, (ends - lengths)[some])
        absent = lists.is_null().to_numpy(zero_copy_only=False)
        if lists.flatten().null_count:
            holes = np.concatenate([[0], np.cumsum(lists.flatten().is_null().to_numpy(zero_copy_only=False))])
            absent |= holes[ends] > holes[ends - lengths]
        return pa.array(out, pa.float64(), mask=absent)

    return F.arrow_udf(sums, "double")(pixels.cast("array<double>"))


def map_bands(px: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], integers: bool = False) -> DataFrame:
    """Each band (height, width, pixels) replaced by ``kernel(band names, (k, h, w) stack)``; all other columns stay.

    A projection in Arrow batches: no shuffle, no call per row. A row whose list does not fit its size gets null pixels. The bands of
    a patch may also stand together in one row, in a column ``bands``.
    """
    columns = px.columns
    value = pa.int32() if integers else pa.float64()
    item = "array<int>" if integers else "array<double>"

    def replaced(bands: pa.Array, height: pa.Array, width: pa.Array, pixels: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        heights, widths = (x.to_numpy(zero_copy_only=False).copy() for x in (height, width))
        names = np.array(bands.to_pylist(), dtype=object)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for rows, stack in list(stacks(pixels, heights, widths)):
            made = kernel(names[rows], stack)
            heights[rows], widths[rows] = made.shape[1:]
            parts.append((rows, made.reshape(len(rows), -1)))
        return pa.array(heights, height.type), pa.array(widths, width.type), _lists(parts, len(names), value)

    if "bands" in columns:
        schema = ", ".join(
            f"`{f.name}` " + (f"array<struct<band: string, height: int, width: int, pixels: {item}>>" if f.name == "bands" else f.dataType.simpleString())
            for f in px.schema)

        def run_patches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = dict(zip(columns, batch.columns))
                flat = held["bands"].flatten()
                given = {f.name: flat.field(k) for k, f in enumerate(flat.type)}
                made = replaced(*(given[c] for c in ("band", "height", "width", "pixels")))
                rows = pa.StructArray.from_arrays([given["band"], *made], ["band", "height", "width", "pixels"])
                counts = held["bands"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                held["bands"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), rows)
                yield pa.RecordBatch.from_arrays([held[c] for c in columns], names=columns)

        return px.mapInArrow(run_patches, schema)
    schema = ", ".join(f"`{f.name}` {item if f.name == 'pixels' else f.dataType.simpleString()}" for f in px.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = dict(zip(columns, batch.columns))
            held["height"], held["width"], held["pixels"] = replaced(*(held[c] for c in ("band", "height", "width", "pixels")))
            yield pa.RecordBatch.from_arrays([held[c] for c in columns], names=columns)

    return px.mapInArrow(run, schema)


def _lists(parts: list[tuple[np.ndarray, np.ndarray]], n: int, value: pa.DataType) -> pa.Array:
    """One list per row from the parts by size, in row order; rows in none are null."""
    place, length = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    begin = 0
    for rows, made in parts:
        place[rows] = begin + np.arange(len(rows)) * made.shape[1]
        length[rows] = made.shape[1]
        begin += made.size
    flat = np.concatenate([made.ravel() for _, made in parts]) if parts else np.zeros(0)
    if len(parts) > 1:  # interleave the sizes as the rows stood
        ends = np.cumsum(length)
        at = np.repeat(place - (ends - length), length) + np.arange(int(ends[-1]))
        flat = flat[at]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(place < 0, False)), pa.array(flat, value, safe=False))
