"""Neighbourhood operators: blocks of pixels with a halo, one shuffle each.

Every pixel goes to the block that holds it and to blocks whose border it can
influence.  A group is one block with its halo, so its size is bounded whatever
the image size, and numpy works on a dense array inside it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from patchloom.functions.geometry import MERCATOR_RADIUS, point_transform
from patchloom.operators.raster import Grid

#: Pixels per block side.
BLOCK = 256
#: Values of one chunk handed to a user function.
CHUNK_VALUES = 4_000_000


def _shifted(dense: np.ndarray, size: int, combine: Callable) -> np.ndarray:
    """Windows combined row by row, then column by column, so a window costs two sides instead of its area."""
    for axis in (0, 1):
        n = dense.shape[axis] - size + 1
        parts = (np.take(dense, range(i, i + n), axis) for i in range(size))
        dense = reduce(combine, parts)
    return dense


def _window_sum(dense: np.ndarray, size: int) -> np.ndarray:
    return _shifted(np.nan_to_num(dense, nan=0.0), size, np.add)


def _window_count(dense: np.ndarray, size: int) -> np.ndarray:
    return _shifted((~np.isnan(dense)).astype(float), size, np.add)


REDUCERS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "sum": _window_sum,
    "mean": lambda d, size: _window_sum(d, size) / np.maximum(_window_count(d, size), 1),
    "min": lambda d, size: _shifted(d, size, np.fmin),
    "max": lambda d, size: _shifted(d, size, np.fmax),
    "count": _window_count,
}


def to_blocks(
    pixels: DataFrame,
    keys: Sequence[str],
    block: int,
    reach_x: Callable[[Column], tuple[Column, Column]],
    reach_y: Callable[[Column], tuple[Column, Column]],
    last_x: int | None = None,
    last_y: int | None = None,
) -> DataFrame:
    """Send each pixel to every block that needs it.

    ``reach_*`` gives, for a pixel coordinate, the lowest and highest output
    coordinate it influences; ``last_*`` is the highest block number, if any.
    NaN is nodata like NULL, for every operator of this module.
    """

    def numbers(c: str, reach: Callable, last: int | None) -> Column:
        lo, hi = reach(F.col(c))
        a, b = F.floor(lo / block), F.floor(hi / block)
        if last is None:
            return F.sequence(a, b)
        a, b = F.greatest(a, F.lit(0).cast("long")), F.least(b, F.lit(last).cast("long"))
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    return (
        pixels.where(F.col("v").isNotNull() & ~F.isnan("v"))
        .select(
            *keys,
            F.col("px").cast("long"),
            F.col("py").cast("long"),
            F.col("v").cast("double"),
            numbers("px", reach_x, last_x).alias("__bx"),
            numbers("py", reach_y, last_y).alias("__by"),
        )
        .withColumn("__bx", F.explode("__bx"))
        .withColumn("__by", F.explode("__by"))
    )


def _run_blocks(blocks: DataFrame, keys: Sequence[str], fn: Callable) -> DataFrame:
    """Apply ``fn(px, py, v, bx, by) -> (px, py, v)`` per block, NaN becoming NULL."""
    types = {f.name: f.dataType.simpleString() for f in blocks.schema}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["px bigint", "py bigint", "v double"])
    n = len(keys)

    def apply(key: tuple, table: pa.Table) -> pa.Table:
        px, py, v = (table[c].to_numpy() for c in ("px", "py", "v"))
        ox, oy, ov = fn(px, py, v, key[n].as_py(), key[n + 1].as_py())
        cols = {k: pa.repeat(key[i], len(ox)) for i, k in enumerate(keys)}
        cols |= {"px": pa.array(ox, pa.int64()), "py": pa.array(oy, pa.int64())}
        cols["v"] = pa.array(ov, pa.float64(), mask=np.isnan(ov))
        return pa.table(cols)

    return blocks.groupBy(*keys, "__bx", "__by").applyInArrow(apply, schema)


def _dense(px, py, v, x0: int, y0: int, w: int, h: int) -> np.ndarray:
    out = np.full((h, w), np.nan)
    out[py - y0, px - x0] = v
    return out


def _halo(
    pixels: DataFrame, keys: Sequence[str], radius: int, block: int, last_x: int | None = None, last_y: int | None = None
) -> DataFrame:
    def reach(c: Column) -> tuple[Column, Column]:
        return c - radius, c + radius

    return to_blocks(pixels, keys, block, reach, reach, last_x, last_y)


def _window_blocks(
    pixels: DataFrame, keys: Sequence[str], radius: int, block: int | None, core: Callable
) -> DataFrame:
    """``core(dense)`` maps the block with halo to values of the block itself.

    Blocks grow with wide windows, so that halos stay a part of the data.
    """
    block = block or max(BLOCK, 4 * radius)

    def fn(px, py, v, bx, by):
        own = (px // block == bx) & (py // block == by)
        if not own.any():
            return px[own], py[own], v[own]
        # only the box that holds own pixels is filled and computed
        ax, zx, ay, zy = px[own].min(), px[own].max(), py[own].min(), py[own].max()
        near = (px >= ax - radius) & (px <= zx + radius) & (py >= ay - radius) & (py <= zy + radius)
        width, height = zx - ax + 1 + 2 * radius, zy - ay + 1 + 2 * radius
        values = core(_dense(px[near], py[near], v[near], ax - radius, ay - radius, width, height))
        return px[own], py[own], values[py[own] - ay, px[own] - ax]

    return _run_blocks(_halo(pixels, keys, radius, block), keys, fn)


def focal(
    pixels: DataFrame,
    size: int,
    fn: str | Callable[[np.ndarray], np.ndarray],
    keys: Sequence[str] = ("band",),
    block: int | None = None,
) -> DataFrame:
    """A function of the odd square window around every pixel that has a value.

    ``fn`` is a reducer name (nodata skipped) or a function from windows
    ``[n, size * size]``, rows first and NaN outside, to ``n`` values. Windows of
    every size take the same way.
    """
    if size % 2 != 1:
        raise ValueError("the window side must be odd")
    r = size // 2
    if isinstance(fn, str):
        named = REDUCERS[fn]
        return _window_blocks(pixels, keys, r, block, lambda dense: named(dense, size))

    def core(dense: np.ndarray) -> np.ndarray:
        h, w = dense.shape[0] - 2 * r, dense.shape[1] - 2 * r
        windows = np.lib.stride_tricks.sliding_window_view(dense, (size, size))
        step = max(1, CHUNK_VALUES // max(1, w * size * size))
        out = [
            np.asarray(fn(windows[i : i + step].reshape(-1, size * size)), dtype=float)
            for i in range(0, h, step)
        ]
        return np.concatenate(out).reshape(h, w)

    return _window_blocks(pixels, keys, r, block, core)


def elevation_percentile(
    pixels: DataFrame, size: int, keys: Sequence[str] = ("band",), block: int | None = None
) -> DataFrame:
    """``(average rank of the centre - 1) / (n - 1) * 100`` in the window.

    Average rank minus one is the smaller values plus half the other equal ones,
    so counting replaces sorting.  An incomplete window gives NULL.
    """
    if size % 2 != 1:
        raise ValueError("the window side must be odd")
    r, n = size // 2, size * size

    def core(dense: np.ndarray) -> np.ndarray:
        h, w = dense.shape[0] - 2 * r, dense.shape[1] - 2 * r
        centre = dense[r : r + h, r : r + w]
        below, same, holes = (np.zeros((h, w)) for _ in range(3))
        for i in range(size):
            for j in range(size):
                other = dense[i : i + h, j : j + w]
                below += other < centre
                same += other == centre
                holes += np.isnan(other)
        out = (below + (same - 1) / 2) / (n - 1) * 100
        out[holes > 0] = np.nan
        return out

    return _window_blocks(pixels, keys, r, block, core)


# --- separable kernels ------------------------------------------------------


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Normalised weights for offsets ``-radius..radius``."""
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def _reflect(i: np.ndarray, n: int) -> np.ndarray:
    """Index reflected about the edges, edge pixel repeated (d c b a | a b c d)."""
    m = np.mod(i, 2 * n)
    return np.where(m < n, m, 2 * n - 1 - m)


def gaussian(
    pixels: DataFrame, grid: Grid, sigma: float, keys: Sequence[str] = ("band",), block: int | None = None
) -> DataFrame:
    """Gaussian smoothing, kernel cut at four deviations, edges reflected.

    Weights are renormalised over pixels with a value, and only those get one.
    """
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    block = block or max(BLOCK, 4 * r)

    def matrix(lo: int, hi: int, n: int, src_lo: int, src_n: int) -> np.ndarray:
        """Weights from source ``src_lo..`` to outputs ``lo..hi``."""
        out = np.arange(lo, hi + 1)
        m = np.zeros((len(out), src_n))
        for o, w in zip(range(-r, r + 1), weights):
            np.add.at(m, (np.arange(len(out)), _reflect(out + o, n) - src_lo), w)
        return m

    def fn(px, py, v, bx, by):
        own = (px // block == bx) & (py // block == by)
        if not own.any():
            return px[own], py[own], v[own]
        sx, sy = max(bx * block - r, 0), max(by * block - r, 0)
        ex, ey = min((bx + 1) * block + r, grid.width), min((by + 1) * block + r, grid.height)
        dense = _dense(px, py, v, sx, sy, ex - sx, ey - sy)
        known = ~np.isnan(dense)
        ox, oy = px[own].min(), py[own].min()
        wx = matrix(ox, px[own].max(), grid.width, sx, ex - sx)
        wy = matrix(oy, py[own].max(), grid.height, sy, ey - sy)
        num = wy @ np.where(known, dense, 0.0) @ wx.T
        den = wy @ known.astype(float) @ wx.T
        at = (py[own] - oy, px[own] - ox)
        return px[own], py[own], num[at] / den[at]

    last = (grid.width - 1) // block, (grid.height - 1) // block
    return _run_blocks(_halo(pixels, keys, r, block, *last), keys, fn)


def _bilinear(d: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(d), 0)


def _cubic(d: np.ndarray) -> np.ndarray:
    # Catmull-Rom, a = -0.5
    a, d = -0.5, np.abs(d)
    inner = ((a + 2) * d - (a + 3)) * d * d + 1
    outer = a * (((d - 5) * d + 8) * d - 4)
    return np.where(d <= 1, inner, np.where(d < 2, outer, 0.0))


KERNELS: dict[str, tuple[Callable, int]] = {"bilinear": (_bilinear, 1), "cubic": (_cubic, 2)}


def _axis_back(src: str, dst: str) -> tuple[Callable, Callable]:
    """numpy functions from ``dst`` coordinates back to ``src``, x and y apart."""
    if src == dst:
        return (lambda x: x), (lambda y: y)
    radius = MERCATOR_RADIUS
    if (src, dst) == ("EPSG:3857", "EPSG:4326"):
        return (
            lambda x: np.radians(x) * radius,
            lambda y: np.log(np.tan(np.pi / 4 + np.radians(y) / 2)) * radius,
        )
    if (src, dst) == ("EPSG:4326", "EPSG:3857"):
        return (
            lambda x: np.degrees(x / radius),
            lambda y: np.degrees(2 * np.arctan(np.exp(y / radius)) - np.pi / 2),
        )
    raise ValueError(f"no transform from {src} to {dst}")


def warp(
    pixels: DataFrame,
    src: Grid,
    dst: Grid,
    method: str = "bilinear",
    keys: Sequence[str] = ("band",),
    block: int | None = None,
    src_crs: str = "",
    dst_crs: str = "",
) -> DataFrame:
    """Interpolate onto another grid, also between the supported projections.

    The kernel widens when the new pixels are larger.  Weights are renormalised
    over source pixels with a value; an output pixel has a value only if the
    source pixel under its centre has one.  Both projections move x and y
    separately, so the weights stay one matrix per axis.
    """
    kernel, support = KERNELS[method]
    move = point_transform(src_crs, dst_crs)
    back_x, back_y = _axis_back(src_crs, dst_crs)

    def source_x(out: np.ndarray) -> np.ndarray:
        return (back_x(dst.left + (out + 0.5) * dst.res) - src.left) / src.res

    def source_y(out: np.ndarray) -> np.ndarray:
        return (src.top - back_y(dst.top - (out + 0.5) * dst.res)) / src.res

    def widest(source: Callable, n: int) -> float:
        ends = np.array([0.0, n / 2, n - 1.0])
        return float(np.abs(source(ends + 0.5) - source(ends - 0.5)).max())

    ratio_x, ratio_y = widest(source_x, dst.width), widest(source_y, dst.height)
    scale_x, scale_y = max(1.0, ratio_x), max(1.0, ratio_y)
    # a block is bounded by the source pixels under it, not by its own
    block = max(1, min(block or BLOCK, int(2 * BLOCK / max(ratio_x, ratio_y))))

    def reach_x(c: Column) -> tuple[Column, Column]:
        ends = [F.lit(src.left) + (c + 0.5 + s * (support * scale_x + 0.5)) * src.res for s in (-1, 1)]
        lo, hi = [(move(e, F.lit(0.0))[0] - dst.left) / dst.res - 0.5 for e in ends]
        return F.floor(lo), F.ceil(hi)

    def reach_y(c: Column) -> tuple[Column, Column]:
        ends = [F.lit(src.top) - (c + 0.5 + s * (support * scale_y + 0.5)) * src.res for s in (-1, 1)]
        lo, hi = [(F.lit(dst.top) - move(F.lit(0.0), e)[1]) / dst.res - 0.5 for e in ends]
        return F.floor(lo), F.ceil(hi)

    blocks = to_blocks(
        pixels, keys, block, reach_x, reach_y, (dst.width - 1) // block, (dst.height - 1) // block
    )

    def weights(centre: np.ndarray, scale: float, lo: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        j = np.arange(lo, lo + n) + 0.5
        return kernel((j[None, :] - centre[:, None]) / scale), np.floor(centre).astype(int) - lo

    def fn(px, py, v, bx, by):
        x0, y0 = int(px.min()), int(py.min())
        w, h = int(px.max()) - x0 + 1, int(py.max()) - y0 + 1
        dense = _dense(px, py, v, x0, y0, w, h)
        known = ~np.isnan(dense)
        ox = np.arange(bx * block, min((bx + 1) * block, dst.width))
        oy = np.arange(by * block, min((by + 1) * block, dst.height))
        wx, nx = weights(source_x(ox), scale_x, x0, w)
        wy, ny = weights(source_y(oy), scale_y, y0, h)
        num = wy @ np.where(known, dense, 0.0) @ wx.T
        den = wy @ known.astype(float) @ wx.T
        inside = ((ny >= 0) & (ny < h))[:, None] & ((nx >= 0) & (nx < w))[None, :]
        under = known[np.clip(ny, 0, h - 1)][:, np.clip(nx, 0, w - 1)]
        ok = inside & under & (np.abs(den) > 1e-9)
        yy, xx = np.nonzero(ok)
        return ox[xx], oy[yy], num[ok] / den[ok]

    return _run_blocks(blocks, keys, fn)


def resample(
    pixels: DataFrame,
    grid: Grid,
    res: float,
    method: str = "cubic",
    keys: Sequence[str] = ("band",),
    block: int | None = None,
) -> tuple[DataFrame, Grid]:
    """Resample to a new pixel side, same north-west corner."""
    dst = Grid(
        grid.left,
        grid.top,
        float(res),
        ceil(grid.width * grid.res / res),
        ceil(grid.height * grid.res / res),
    )
    return warp(pixels, grid, dst, method, keys, block), dst


def align(
    pixels: DataFrame,
    grid: Grid,
    ref: Grid,
    keys: Sequence[str] = ("band",),
    block: int | None = None,
    src_crs: str = "",
    dst_crs: str = "",
) -> DataFrame:
    """Bring an image onto the reference grid (bilinear); nodata elsewhere."""
    return warp(pixels, grid, ref, "bilinear", keys, block, src_crs, dst_crs)
