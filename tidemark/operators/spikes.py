"""Implausible readings of bars, relative to each source's own behaviour."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ship

#: Rows of whole sources that are worked on at once; bounds a task's memory.
ROWS_AT_ONCE = 100_000
REASONS = ("limit", "contradiction", "price_spike", "range_spike", "volume_spike", "stuck_close", "stuck_volume")


@dataclass(frozen=True)
class Limits:
    """Cutoffs in robust standard deviations of the source's own residuals, and run lengths: of stuck readings at
    the least, of a change that passes at the most.

    A source of fewer than ``least_rows`` rows has no scale to speak of, as one spike is half of its moves; it takes ``few_price`` (of log prices) or
    ``few_volume`` (of decimal logarithms), a wide scale for a daily move. A first or last close has one
    neighbour, so a lasting change can't be told from a spike there: it must depart by ``edge`` scales and by ``edge_price`` (a factor of
    five). ``reach``: how far a high or low lies beyond the closes of the day and of its neighbours.
    """

    price: float = 6.5
    volume: float = 4.0
    wick: float = 7.0
    volume_log10: float = 1.35
    run: int = 5
    passing: int = 4
    least_rows: int = 8
    few_price: float = 0.1
    few_volume: float = 0.2
    edge: float = 20.0
    edge_price: float = 1.6
    reach: float = 20.0


def segment_median(x: np.ndarray, seg: np.ndarray, n: int) -> np.ndarray:
    """Median of ``x`` by segment, NaN values aside; NaN for a segment without values."""
    ok = ~np.isnan(x)
    x, seg = x[ok], seg[ok]
    order = np.lexsort((x, seg))
    x, seg = x[order], seg[order]
    begin = np.searchsorted(seg, np.arange(n), "left")
    size = np.searchsorted(seg, np.arange(n), "right") - begin
    out = np.full(n, np.nan)
    some = size > 0
    lo = begin[some] + (size[some] - 1) // 2
    hi = begin[some] + size[some] // 2
    out[some] = (x[lo] + x[hi]) / 2
    return out


def robust_scale(x: np.ndarray, seg: np.ndarray, n: int) -> np.ndarray:
    """1.4826 times the median absolute deviation from the segment's median."""
    return 1.4826 * segment_median(np.abs(x - segment_median(x, seg, n)[seg]), seg, n)


def _neighbour(x: np.ndarray, seg: np.ndarray, k: int) -> np.ndarray:
    """The value ``k`` rows on within the segment, NaN beyond its ends."""
    out = np.full(len(x), np.nan)
    if k > 0:
        same = seg[k:] == seg[:-k]
        out[:-k][same] = x[k:][same]
    else:
        same = seg[:k] == seg[-k:]
        out[-k:][same] = x[:k][same]
    return out


def _phi(r: np.ndarray, before: np.ndarray, scale: np.ndarray, seg: np.ndarray, n: int) -> np.ndarray:
    """Robust AR(1) coefficient by segment: least squares with bisquare weights, reweighted thrice."""
    ok = ~(np.isnan(r) | np.isnan(before)) & (scale[seg] > 0)
    s, y, z, unit = seg[ok], r[ok], before[ok], scale[seg[ok]]
    weight = lambda e: np.clip(1 - (e / (4.685 * unit)) ** 2, 0, None) ** 2
    phi = np.zeros(n)
    for _ in range(3):
        w = weight(y - phi[s] * z) * weight(z)
        num = np.bincount(s, w * y * z, n)
        den = np.bincount(s, w * z * z, n)
        phi = np.where(den > 0, num / np.where(den > 0, den, 1), 0)
        phi = np.clip(phi, -0.9, 0.9)
    return phi


def passing_changes(v: np.ndarray, seg: np.ndarray, unit: np.ndarray, cut: float, most: int) -> np.ndarray:
    """Rows of runs of 2 to ``most`` between two opposite level shifts: every row departs from the row before the run and
    from the row after it by ``cut`` scales in the same direction, these two differ by less than half of that, and they
    are nearer to the median of the ten rows on either side than the run is. The shortest run counts."""
    out = np.zeros(len(v), bool)
    if len(v) < 4:
        return out
    usual = _median(np.vstack([_neighbour(v, seg, k) for k in range(-10, 11) if k]))
    for size in range(2, most + 1):
        before, after = _neighbour(v, seg, -1), _neighbour(v, seg, size)
        inside = np.vstack([_neighbour(v, seg, k) if k else v for k in range(size)])
        with np.errstate(invalid="ignore"):
            up = np.minimum(inside - before, inside - after).min(axis=0)
            down = np.minimum(before - inside, after - inside).min(axis=0)
            least = np.maximum(up, down)
            back = np.abs(after - before) < least / 2
            outer = np.maximum(np.abs(before - usual), np.abs(after - usual))
            hit = (least >= cut * unit) & back & (outer < np.abs(inside - usual).min(axis=0))
        for k in range(size):
            out[np.flatnonzero(hit) + k] = True
        if out.any():
            break
    return out


def fit(x: np.ndarray, seg: np.ndarray, n: int, lim: Limits, few: float) -> tuple[np.ndarray, np.ndarray]:
    """Robust scale of the innovations and AR(1) coefficient by segment; of a short segment ``few`` and none."""
    before = x - _neighbour(x, seg, -1)
    scale = np.maximum(robust_scale(before, seg, n), 1e-4)
    short = np.bincount(seg, minlength=n) < lim.least_rows
    scale = np.where(short, few, scale)
    return scale, np.where(short, 0, _phi(before, _neighbour(before, seg, -1), scale, seg, n))


def additive_outliers(x: np.ndarray, seg: np.ndarray, n: int, cut: float, lim: Limits, few: float, edge: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a level series that are additive outliers, and the scale of its innovations by segment.

    The series' differences follow a robust AR(1) per segment. At each row the effect of an
    additive outlier (the level leaves and comes back) and that of a level shift (it stays) are
    estimated from the residuals. A row is an outlier if it departs from both neighbours by
    ``cut`` scales in the same direction and the additive model explains more than the shift. In every
    round the strongest row of its neighbourhood is taken out, the model of its segment is fitted again and the rows around it meet their new
    neighbours. When none is left, short runs that leave the level and come back are taken out
    (``passing_changes``), then first and last rows that depart from the model's forecast by ``lim.edge`` scales and by ``edge``, and the rounds go on. They
    end when nothing is left; each takes out a row at least.
    """
    out = np.zeros(len(x), bool)
    live = np.flatnonzero(~np.isnan(x))
    scale, phi = fit(x[live], seg[live], n, lim, few)
    while len(live):
        v, s = x[live], seg[live]
        before = v - _neighbour(v, s, -1)
        f, unit = phi[s], scale[s]
        e = before - f * np.nan_to_num(_neighbour(before, s, -1))
        e1, e2 = _neighbour(e, s, 1), np.nan_to_num(_neighbour(e, s, 2))
        additive = np.abs(e - (1 + f) * e1 + f * e2) / np.sqrt(1 + (1 + f) ** 2 + f**2) / unit
        shift = np.abs(e - f * e1) / np.sqrt(1 + f**2) / unit
        after = -_neighbour(before, s, 1)  # departure from the next row
        both = np.where(np.sign(before) == np.sign(after), np.minimum(np.abs(before), np.abs(after)), 0) / unit
        with np.errstate(invalid="ignore"):
            hit = (both >= cut) & (additive > shift)
        if hit.any():
            strength = np.where(hit, both, 0)
            for k in (-2, -1, 1, 2):
                hit &= strength >= np.nan_to_num(_neighbour(strength, s, k))
        else:
            hit = passing_changes(v, s, unit, cut, lim.passing)
        if not hit.any() and np.isfinite(edge):
            first, last = np.isnan(before), np.isnan(after)
            back = -(after - f * np.nan_to_num(_neighbour(after, s, 1)))  # the model runs backwards as well
            off = np.where(last & ~first, np.abs(e), np.where(first & ~last, np.abs(back), 0))
            third = np.bincount(s, minlength=n)[s] > 2  # of two rows none is the odd one
            with np.errstate(invalid="ignore"):
                hit = third & (off >= lim.edge * unit) & (off >= edge)
        if not hit.any():
            break
        out[live[hit]] = True
        again = np.zeros(n, bool)
        again[s[hit]] = True
        live = live[~hit]
        rows = live[again[seg[live]]]
        new_scale, new_phi = fit(x[rows], seg[rows], n, lim, few)
        fitted = again & ~np.isnan(new_scale)
        scale, phi = np.where(fitted, new_scale, scale), np.where(fitted, new_phi, phi)
    return out, scale


def runs(x: np.ndarray, seg: np.ndarray, least: int) -> np.ndarray:
    """Rows that repeat the row before in a run of at least ``least`` equal values; NaN breaks a run."""
    if not len(x):
        return np.zeros(0, bool)
    new = np.ones(len(x), bool)
    new[1:] = (seg[1:] != seg[:-1]) | ~(x[1:] == x[:-1])
    run = np.cumsum(new) - 1
    return (np.bincount(run)[run] >= least) & ~new


def judge(seg, o, h, l, c, v, lim: Limits) -> dict[str, np.ndarray]:  # noqa: E741
    """Flags by reason of rows sorted by segment and day. Minus infinity stands for a null
    price, NaN for a null volume."""
    n = int(seg.max()) + 1 if len(seg) else 0
    prices = np.vstack([o, h, l, c])
    null = np.isneginf(prices)  # the caller's mark for null
    with np.errstate(invalid="ignore"):
        bad = (~np.isfinite(prices) | (prices <= 0)) & ~null
        limit = bad.any(axis=0) | (v < 0)
        sound = ~bad.any(axis=0) & ~null.any(axis=0)
        p = np.where(sound, prices, np.nan)
        slack = 1e-9 * np.abs(p[3])
        contradiction = (p[1] < np.maximum(np.maximum(p[0], p[3]), p[2]) - slack) | (
            p[2] > np.minimum(np.minimum(p[0], p[3]), p[1]) + slack
        )
    use = sound & ~contradiction
    x = np.where(use, np.log(np.where(use, p[3], 1)), np.nan)
    price, scale = additive_outliers(x, seg, n, lim.price, lim, lim.few_price, lim.edge_price)
    with np.errstate(invalid="ignore", divide="ignore"):
        lp = np.log(np.where(use, p, np.nan))
        top, bottom = np.maximum(lp[0], lp[3]), np.minimum(lp[0], lp[3])
        wick = np.maximum(lp[1] - top, bottom - lp[2]) / scale[seg] if n else np.zeros(0)
        # A wrong open takes the body with it: the closes around the row don't.
        sane = np.where(price, np.nan, lp[3])
        closes = np.vstack([sane, _neighbour_valid(sane, seg, -1), _neighbour_valid(sane, seg, 1)])
        known = (~np.isnan(closes)).sum(axis=0) > 1
        reach = np.maximum(lp[1] - np.fmax.reduce(closes), np.fmin.reduce(closes) - lp[2]) / scale[seg] if n else np.zeros(0)
        range_ = (wick >= lim.wick) | (known & (reach >= lim.reach))
        volume = np.where(v > 0, np.log10(np.where(v > 0, v, 1)), np.nan)
    # A reading of volume must be an additive outlier of its autoregression and lie a factor away from its neighbours'
    # median: the first test lets lasting changes pass, the second busy days.
    outlier, _ = additive_outliers(volume, seg, n, lim.volume, lim, lim.few_volume)
    around = np.vstack([_neighbour_valid(volume, seg, k) for k in (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5)]) if n else np.zeros((10, 0))
    with np.errstate(invalid="ignore"):
        own = segment_median(volume, seg, n)[seg] if n else volume
        local = np.where(np.sum(~np.isnan(around), axis=0) >= 3, _median(around), np.nan)
        far = lambda ref: np.abs(volume - ref) >= lim.volume_log10
        # The first and the last reading have one neighbour; there the source's own median stands for the other.
        edge = np.isnan(_neighbour_valid(volume, seg, -1)) | np.isnan(_neighbour_valid(volume, seg, 1))
        enough = np.bincount(seg[~np.isnan(volume)], minlength=n)[seg] > 3 if n else np.zeros(0, bool)
        vol = far(local) & (outlier | (edge & enough & far(own)))
    stuck_c = runs(np.where(null[3] | ~np.isfinite(c), np.nan, c), seg, lim.run)
    stuck_v = runs(np.where((v == 0) | np.isnan(v), np.nan, v), seg, lim.run)
    return dict(zip(REASONS, (limit, contradiction, price, range_, vol, stuck_c, stuck_v)))


def _neighbour_valid(x: np.ndarray, seg: np.ndarray, k: int) -> np.ndarray:
    """Like ``_neighbour`` among the rows that have a value."""
    out = np.full(len(x), np.nan)
    at = np.flatnonzero(~np.isnan(x))
    out[at] = _neighbour(x[at], seg[at], k)
    return out


def _median(rows: np.ndarray) -> np.ndarray:
    """Column medians, NaN aside; sorting puts NaN last."""
    ordered = np.sort(rows, axis=0)
    size = np.sum(~np.isnan(rows), axis=0)
    lo, hi = np.maximum((size - 1) // 2, 0), np.minimum(size // 2, len(rows) - 1)
    at = np.arange(rows.shape[1])
    return np.where(size > 0, (ordered[lo, at] + ordered[hi, at]) / 2, np.nan)


def implausible_readings(
    bars: DataFrame, entity: str, day: str, prices: tuple[str, str, str, str], volume: str, limits: Limits = Limits()
) -> DataFrame:
    """Days on which a source's bar holds an implausible reading, with the reasons.

    ``bars``: one row per (entity, day); ``prices`` names open, high, low, close. Output:
    ``entity``, ``day`` and ``reasons`` (array of strings out of ``REASONS``), one row per flagged bar.

    Semantics
    - ``limit``: a price that is NaN, infinite, zero or negative, or a negative volume.
    - ``contradiction``: high below, or low above, another price of the row.
    - ``price_spike``: the close is an additive outlier of the source's robust autoregression, or one of at most
      ``limits.passing`` bars in a row that leave the level and come back; a lasting change of level is a level shift and no case. A first or
      last close has one neighbour; it must depart from the forecast by ``limits.edge`` scales and a factor of five.
    - ``range_spike``: high or low lies outside the row's body by ``limits.wick`` of the source's scales, or beyond the closes of the
      row and its neighbours by ``limits.reach``.
    - ``volume_spike``: the volume's logarithm is such an outlier or run of its robust autoregression and a factor of
      ``10 ** volume_log10`` away from its neighbours' median; a first or last volume, also from the source's own.
    - ``stuck_*``: an unchanged close or volume in at least ``limits.run`` consecutive bars, the first aside.
    - Null prices and null or zero volume are no reading; rows with any null price take no
      part in the spike tests. Sources of fewer than ``limits.least_rows`` rows are measured by a fixed scale. Rows
      with a null entity or day are ignored. An empty table gives no rows.

    Scale: one shuffle by entity. Sources stream through sorted; about ``ROWS_AT_ONCE`` rows of whole
    sources are judged together by array operations. One source's rows are bounded by the calendar.
    """
    ship(bars.sparkSession)
    names = [*prices, volume]
    rows = (
        bars.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .select(
            F.col(entity).cast("string").alias("e"),
            F.col(day).cast("date").alias("d"),
            *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(names)],
        )
        .repartition("e")
        .sortWithinPartitions("e", "d")
    )

    def flagged(t: pa.Table) -> Iterator[pa.RecordBatch]:
        seg = t["e"].combine_chunks().dictionary_encode().indices.to_numpy()
        cols = []
        for i in range(5):
            a = t[f"x{i}"].combine_chunks()
            x = a.to_numpy(zero_copy_only=False).astype(float)
            cols.append(np.where(a.is_null().to_numpy(zero_copy_only=False), -np.inf if i < 4 else np.nan, x))
        for i in range(4):  # a real minus infinity must not read as null
            valid = t[f"x{i}"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            cols[i] = np.where(valid & np.isneginf(cols[i]), np.inf, cols[i])
        flags = judge(seg, *cols, limits)
        grid = np.vstack([flags[r] for r in REASONS])
        at = np.flatnonzero(grid.any(axis=0))
        if len(at):
            lists = pa.array([[REASONS[k] for k in np.flatnonzero(grid[:, j])] for j in at], pa.list_(pa.string()))
            idx = pa.array(at)
            yield from pa.table({"e": t["e"].take(idx), "d": t["d"].take(idx), "reasons": lists}).to_batches()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count < ROWS_AT_ONCE:
                continue
            t = pa.Table.from_batches(held)
            last = t["e"][-1].as_py()
            whole = int(np.searchsorted(_is(t["e"], last), True))  # the last source may go on
            if whole:
                yield from flagged(t.slice(0, whole))
                held = t.slice(whole).to_batches()
                count = t.num_rows - whole
        if held:
            yield from flagged(pa.Table.from_batches(held))

    out = rows.mapInArrow(judged, "e string, d date, reasons array<string>")
    return out.select(F.col("e").alias(entity), F.col("d").alias(day), "reasons")


def _is(column: pa.ChunkedArray, value: str) -> np.ndarray:
    return pc.equal(column, value).to_numpy()
