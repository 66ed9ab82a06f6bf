"""The functions of formulas over whole arrays: numpy counterparts used inside Arrow tasks.

An array holds the values of several instruments one after the other; ``Segments`` knows where each
begins. NaN stands for a missing value. Every rolling function costs constant or logarithmic work a row,
whatever its window:

* extremes: two passes over blocks of the window's size, the prefix extreme from a block's start and the suffix
  extreme to its end; a window is one suffix and one prefix;
* count, mean and spread: moments of the same prefixes and suffixes, merged. Each is measured from its own
  first or last value, which lies in the window, so large values do not cancel;
* rank and median: a wavelet matrix of the segment's ranks counts or selects in any window.

Windows up to ``SHORT`` rows without a missing value are read by shifting whole arrays against each other, others as rows
of a matrix; both give the same values, to the last digit.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property

import numpy as np

SHORT = 32
CELLS = 1 << 20
SHIFTED = 1 << 15  # rows shifted at once
LARGEST = 1.7976931348623157e308


class Segments:
    """Lengths of the series that lie one after the other in an array."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = np.asarray(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.rows = int(self.ends[-1]) if len(self.ends) else 0
        self._shifts: dict[int, Shifts] = {}

    @cached_property
    def place(self) -> np.ndarray:
        """The number of a row inside its series."""
        return np.arange(self.rows) - np.repeat(self.starts, self.sizes)

    def spread(self, values: np.ndarray) -> np.ndarray:
        return np.repeat(values, self.sizes)

    def all_zero(self, x: np.ndarray) -> np.ndarray:
        """For each series, whether all its values are zero."""
        if not self.rows or (x[self.starts[self.sizes > 0]] != 0).all():
            return self.sizes == 0
        other = np.concatenate([[0], np.cumsum(x != 0)])
        return other[self.ends] == other[self.starts]

    def each(self, call: Callable[[np.ndarray], np.ndarray], x: np.ndarray) -> np.ndarray:
        out = np.empty(self.rows)
        for a, b in zip(self.starts.tolist(), self.ends.tolist()):
            if b > a:
                out[a:b] = call(x[a:b])
        return out

    def windows(
        self, call: Callable[[np.ndarray], np.ndarray], x: np.ndarray, size: int, rows: np.ndarray | None = None
    ) -> np.ndarray:
        """``call`` over the rows of a matrix of windows, NaN before a series begins; the last column is the row itself.

        With ``rows``, their numbers, only the windows of these.
        """
        if not len(x):
            return x
        padded = np.concatenate([np.full(size - 1, np.nan), x])
        view = np.lib.stride_tricks.sliding_window_view(padded, size)
        count = len(x) if rows is None else len(rows)
        out = np.empty(count)
        step = max(CELLS // size, 1)
        back = np.arange(size - 1, -1, -1)
        for a in range(0, count, step):
            own = slice(a, a + step) if rows is None else rows[a : a + step]
            part, place = view[own].copy(), self.place[own]
            head = np.flatnonzero(place < size - 1)
            part[head] = np.where(back > place[head, None], np.nan, part[head])
            out[a : a + step] = call(part)
        return out

    def shifts(self, size: int) -> Shifts:
        """How windows of ``size`` rows are laid out for shifting."""
        if size not in self._shifts:
            self._shifts[size] = Shifts(self, size)
        return self._shifts[size]


class Shifts:
    """Series apart by ``size - 1`` empty places, so that a window of a row reaches into no other series.

    A window begins at the place ``at`` of its row. ``held`` counts the rows of each window, ``empty`` are the (offset,
    place) pairs of empty places in windows of rows, by place.
    """

    def __init__(self, segments: Segments, size: int):
        self.size, self.segments = size, segments
        gap = size - 1
        filled = np.flatnonzero(segments.sizes)
        starts, ends = segments.starts[filled], segments.ends[filled]
        first = starts + gap * np.arange(len(filled))
        self.runs = list(zip(first.tolist(), starts.tolist(), ends.tolist()))
        self.at = np.arange(segments.rows) + np.repeat(first - starts, ends - starts)
        self.places = segments.rows + gap * len(filled)
        self.others = np.minimum(segments.place, gap)
        self.held = self.others + 1.0
        self.ranked = np.maximum(self.others, 1.0)
        self.heads = np.flatnonzero(segments.place < gap)

    @cached_property
    def counts(self) -> np.ndarray:
        counts = np.full(max(self.places - self.size + 1, 0), float(self.size))
        counts[self.at] = self.held
        return counts

    @cached_property
    def empty(self) -> tuple[np.ndarray, np.ndarray]:
        short = self.size - 1 - self.others[self.heads]
        first = np.cumsum(short) - short
        return np.arange(short.sum()) - np.repeat(first, short), np.repeat(self.at[self.heads], short)

    def run(self, call: Callable[[np.ndarray, int, int], np.ndarray], x: np.ndarray, fill: float) -> np.ndarray:
        """``call(values, first, count)`` gives ``count`` windows from place ``first`` on, a stretch at a time."""
        spread = np.full(self.places, fill)
        gap = self.size - 1
        for place, a, b in self.runs:
            spread[place + gap : place + gap + b - a] = x[a:b]
        windows = self.places - gap
        if windows <= SHIFTED:
            found = call(spread, 0, windows)
        else:
            found = np.empty(windows)
            for a in range(0, windows, SHIFTED):
                n = min(SHIFTED, windows - a)
                found[a : a + n] = call(spread[a : a + n + gap], a, n)
        out = np.empty(self.segments.rows)
        for place, a, b in self.runs:
            out[a:b] = found[place : place + b - a]
        return out


def whole(x: np.ndarray) -> bool:
    """Whether no value is missing or infinite: one would show in the sum of squares, which may only overflow besides."""
    return (x.ndim == 1 and math.isfinite(x.dot(x))) or bool(np.isfinite(x).all())


def finite(x: np.ndarray) -> np.ndarray:
    """Infinities become missing."""
    return x if whole(x) else np.where(np.isfinite(x), x, np.nan)


def or_zero(x: np.ndarray) -> np.ndarray:
    return x if whole(x) else np.where(np.isfinite(x), x, 0.0)


# ---- scalar functions ------------------------------------------------------------------------


def safe_div(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return or_zero(np.divide(a, b))


def safe_log(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return or_zero(np.log(x))


def safe_sqrt(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return or_zero(np.sqrt(x))


SCALARS: dict[str, Callable[..., np.ndarray]] = {
    "safe_add": lambda a, b: or_zero(a + b),
    "safe_sub": lambda a, b: or_zero(a - b),
    "safe_mul": lambda a, b: or_zero(a * b),
    "safe_div": safe_div,
    "safe_log": safe_log,
    "safe_sqrt": safe_sqrt,
    "safe_abs": lambda x: or_zero(np.abs(x)),
}


# ---- short windows ---------------------------------------------------------------------------


def _moments(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    held = ~np.isnan(w)
    n = held.sum(axis=1)
    least = np.maximum(n, 1)
    mean = np.where(held, w, 0.0).sum(axis=1) / least
    gaps = np.where(held, w - mean[:, None], 0.0)
    return n, mean, (gaps * gaps).sum(axis=1)


def _short_rank(w: np.ndarray) -> np.ndarray:
    return (w <= w[:, -1:]).sum(axis=1) - 1.0


def _short_median(w: np.ndarray) -> np.ndarray:
    w = np.sort(w, axis=1)  # missing values come last
    n = w.shape[1] - np.isnan(w).sum(axis=1)
    row = np.arange(len(w))
    low, high = w[row, np.maximum(n - 1, 0) // 2], w[row, np.minimum(n // 2, w.shape[1] - 1)]
    return np.where(n > 0, (low + high) / 2, np.nan)


def _short_std(w: np.ndarray) -> np.ndarray:
    n, _, spread = _moments(w)
    return np.sqrt(spread / np.maximum(n, 1))


SHORT_WINDOWS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "max": lambda w: np.fmax.reduce(w, axis=1),
    "min": lambda w: np.fmin.reduce(w, axis=1),
    "sum": lambda w: np.where(np.isnan(w), 0.0, w).sum(axis=1),
    "mean": lambda w: _moments(w)[1],
    "std": _short_std,
    "rank": _short_rank,
    "median": _short_median,
}


# ---- short windows without a missing value, by shifts ----------------------------------------


def _added(parts: np.ndarray) -> np.ndarray:
    """The sum of the rows of ``parts`` in the order in which a row of a matrix is added: eight sums side by side."""
    most = len(parts) - len(parts) % 8
    if not most:
        total, rest = parts[0], parts[1:]
    else:
        eight, rest = parts[:8], parts[most:]
        for i in range(8, most, 8):
            eight += parts[i : i + 8]
        while len(eight) > 1:
            eight = eight[::2] + eight[1::2]
        total = eight[0]
    for part in rest:
        total += part
    return total


def _shifted_sum(values: np.ndarray, size: int, n: int) -> np.ndarray:
    """As ``_added``; a sum of neighbours is made once for all windows that have it."""
    most = size - size % 8
    if not most:
        total = values[:n].copy()
    else:
        total = values
        for i in range(8, most, 8):
            total = total[: len(values) - i] + values[i:]
        for step in (1, 2, 4):
            total = total[:-step] + total[step:]
        total = total[:n]
    for k in range(most or 1, size):
        total += values[k : k + n]
    return total


def _merge(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Two ascending lists of arrays, place by place, as one (odd-even merge)."""
    if not a or not b:
        return a or b
    if len(a) == len(b) == 1:
        return [np.minimum(a[0], b[0]), np.maximum(a[0], b[0])]
    even, odd = _merge(a[::2], b[::2]), _merge(a[1::2], b[1::2])
    out = [even[0]]
    for i in range(max(len(even) - 1, len(odd))):
        if i < len(odd) and i + 1 < len(even):
            out += [np.minimum(odd[i], even[i + 1]), np.maximum(odd[i], even[i + 1])]
        else:
            out.append(odd[i] if i < len(odd) else even[i + 1])
    return out


def _kth(a: list[np.ndarray], b: list[np.ndarray], k: int) -> np.ndarray:
    """The value with ``k`` others before it among two ascending lists, place by place."""
    found = None
    for i in range(max(k + 1 - len(b), 0), min(k + 1, len(a)) + 1):
        j = k + 1 - i
        most = a[i - 1] if not j else b[j - 1] if not i else np.maximum(a[i - 1], b[j - 1])
        found = most if found is None else np.minimum(found, most)
    return found


def _shifted_median(values: np.ndarray, size: int, n: int) -> np.ndarray:
    """Runs of two, four, ... neighbours are ordered once for all windows that have them."""
    cut = lambda run, k: [r[k : k + n] for r in run]
    runs, width = [[values]], 1
    while 2 * width <= size:
        run = runs[-1]
        size_left = len(run[0]) - width
        runs.append(_merge([r[:size_left] for r in run], [r[width:] for r in run]))
        width *= 2
    first, rest, at = cut(runs[-1], 0), [], width
    for step in range(len(runs) - 2, -1, -1):
        if size - at >= 1 << step:
            rest = _merge(cut(runs[step], at), rest)
            at += 1 << step
    low = _kth(first, rest, (size - 1) // 2)
    return low if size % 2 else (low + _kth(first, rest, size // 2)) / 2


def _shifted_extreme(pick: np.ufunc) -> Callable[[np.ndarray, int, int], np.ndarray]:
    def run(values: np.ndarray, size: int, n: int) -> np.ndarray:
        width = 1
        while 2 * width <= size:
            values = pick(values[:-width], values[width:])
            width *= 2
        return pick(values[:n], values[size - width : size - width + n])

    return run


def _view(values: np.ndarray, size: int) -> np.ndarray:
    """Row ``k`` is what lies ``k`` places after the beginning of each window."""
    return np.ndarray((size, len(values) - size + 1), values.dtype, values, 0, values.strides * 2)


def _shifted_rank(values: np.ndarray, size: int, n: int) -> np.ndarray:
    return np.less_equal(_view(values, size), values[size - 1 :]).view(np.uint8).sum(axis=0, dtype=np.uint8) - 1.0


# what an empty place holds, and the windows
SHIFTED_WINDOWS: dict[str, tuple[float, Callable[[np.ndarray, int, int], np.ndarray]]] = {
    "max": (-np.inf, _shifted_extreme(np.maximum)),
    "min": (np.inf, _shifted_extreme(np.minimum)),
    "sum": (0.0, _shifted_sum),
    "mean": (0.0, _shifted_sum),
    "median": (0.0, _shifted_median),
    "rank": (np.nan, _shifted_rank),
}


def _shifted_std(shifts: Shifts) -> Callable[[np.ndarray, int, int], np.ndarray]:
    size = shifts.size

    def run(values: np.ndarray, first: int, n: int) -> np.ndarray:
        counts = shifts.counts[first : first + n]
        mean = _shifted_sum(values, size, n) / counts
        gaps = np.subtract(_view(values, size), mean, order="C")
        offset, place = shifts.empty
        a, b = np.searchsorted(place, (first, first + n))
        gaps[offset[a:b], place[a:b] - first] = 0.0
        gaps *= gaps
        return np.sqrt(_added(gaps) / counts)

    return run


def shifted(fn: str, x: np.ndarray, segments: Segments, size: int) -> np.ndarray:
    """A short window function where no value is missing."""
    if not len(x):
        return x
    shifts = segments.shifts(size)
    if fn == "std":
        return shifts.run(_shifted_std(shifts), x, 0.0)
    fill, call = SHIFTED_WINDOWS[fn]
    out = shifts.run(lambda values, _, n: call(values, size, n), x, fill)
    if fn == "mean":
        out /= shifts.held
    elif fn == "median":
        out[shifts.heads] = segments.windows(_short_median, x, size, shifts.heads)
    return out


# ---- long windows ----------------------------------------------------------------------------


def _blocks(x: np.ndarray, size: int) -> np.ndarray:
    count = -(-len(x) // size)
    return np.concatenate([x, np.full(count * size - len(x), np.nan)]).reshape(count, size)


def _extreme(pick: np.ufunc) -> Callable[[np.ndarray, int], np.ndarray]:
    def run(x: np.ndarray, size: int) -> np.ndarray:
        blocks = _blocks(x, size)
        out = pick.accumulate(blocks, axis=1).ravel()[: len(x)].copy()
        suffix = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        if len(x) >= size:
            out[size - 1 :] = pick(out[size - 1 :], suffix[: len(x) - size + 1])
        return out

    return run


def _growing(blocks: np.ndarray) -> list[np.ndarray]:
    """From the start of each block to each place: count, mean and summed squares around it, the mean measured from an
    anchor, and the anchor, the block's first value."""
    held = ~np.isnan(blocks)
    first = np.argmax(held, axis=1)
    anchor = np.where(held.any(axis=1), blocks[np.arange(len(blocks)), first], 0.0)[:, None]
    gap = np.where(held, blocks - anchor, 0.0)
    n = np.cumsum(held, axis=1)
    one, two = np.cumsum(gap, axis=1), np.cumsum(gap * gap, axis=1)
    least = np.maximum(n, 1)
    return [n, one / least, np.maximum(two - one * one / least, 0.0), np.broadcast_to(anchor, blocks.shape)]


def window_moments(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and summed squares around the mean of each trailing window of one series."""
    blocks = _blocks(x, size)
    n, mean, spread, anchor = (p.ravel()[: len(x)].copy() for p in _growing(blocks))
    if len(x) >= size:
        back = [p[:, ::-1].ravel()[: len(x) - size + 1].copy() for p in _growing(blocks[:, ::-1])]
        back[0][::size] = 0  # a window that is a whole block is its prefix already
        m, other, own, far = back
        here = slice(size - 1, None)
        total = n[here] + m
        least = np.maximum(total, 1)
        # the difference of two anchors is exact where values lie close together
        gap = np.where(n[here] > 0, (far - anchor[here]) + (other - mean[here]), 0.0)
        merged = np.where(n[here] > 0, mean[here] + gap * m / least, other)
        anchor[here] = np.where(n[here] > 0, anchor[here], far)
        spread[here] += np.where(m > 0, own + gap * gap * n[here] * m / least, 0.0)
        mean[here] = np.where(m > 0, merged, mean[here])
        n[here] = total
    return n, anchor + mean, spread


class WaveletMatrix:
    """Counts and selects among the ranks at any run of places, in as many steps as a rank has bits."""

    def __init__(self, ranks: np.ndarray):
        top = int(ranks.max(initial=0))
        self.bits = max(top.bit_length(), 1)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(self.bits - 1, -1, -1):
            zero = (ranks >> bit) & 1 == 0
            before = np.concatenate([[0], np.cumsum(zero)]).astype(np.int32)
            self.levels.append((bit, before, int(before[-1])))
            ranks = np.concatenate([ranks[zero], ranks[~zero]])

    def below(self, first: np.ndarray, last: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many ranks at places first .. last - 1 are smaller than ``rank``, at most the largest rank held."""
        found = np.zeros(len(rank), np.int64)
        for bit, before, zeros in self.levels:
            a, b = before[first], before[last]
            one = (rank >> bit) & 1 == 1
            found += np.where(one, b - a, 0)
            first = np.where(one, zeros + first - a, a)
            last = np.where(one, zeros + last - b, b)
        return found

    def select(self, first: np.ndarray, last: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The rank that has ``k`` others before it in order, at places first .. last - 1."""
        found = np.zeros(len(k), np.int64)
        for bit, before, zeros in self.levels:
            a, b = before[first], before[last]
            one = k >= b - a
            found |= np.where(one, 1 << bit, 0)
            k = np.where(one, k - (b - a), k)
            first = np.where(one, zeros + first - a, a)
            last = np.where(one, zeros + last - b, b)
        return found


def _ordered(x: np.ndarray, size: int) -> tuple[np.ndarray, WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """Values in order, their matrix, and for each row its window among the values that are not missing."""
    held = ~np.isnan(x)
    upto = np.concatenate([[0], np.cumsum(held)])
    values, ranks = np.unique(x[held], return_inverse=True)
    rows = np.arange(len(x))
    first, last = upto[np.maximum(rows - size + 1, 0)], upto[rows + 1]
    return values, WaveletMatrix(ranks), ranks, first, last


def _long_rank(x: np.ndarray, size: int) -> np.ndarray:
    held = np.flatnonzero(~np.isnan(x))
    out = np.full(len(x), np.nan)
    if len(held):
        values, matrix, ranks, first, last = _ordered(x, size)
        a, b = first[held], last[held]
        most = ranks == len(values) - 1
        upto = matrix.below(a, b, np.where(most, 0, ranks + 1))
        out[held] = np.where(most, b - a, upto) - 1.0
    return out


def _long_median(x: np.ndarray, size: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    values, matrix, _, first, last = _ordered(x, size)
    some = np.flatnonzero(last > first)
    if len(some):
        a, b = first[some], last[some]
        low, high = matrix.select(a, b, (b - a - 1) // 2), matrix.select(a, b, (b - a) // 2)
        out[some] = (values[low] + values[high]) / 2
    return out


def _long_std(x: np.ndarray, size: int) -> np.ndarray:
    n, _, spread = window_moments(x, size)
    return np.sqrt(spread / np.maximum(n, 1))


def _long_mean(x: np.ndarray, size: int) -> np.ndarray:
    n, mean, _ = window_moments(x, size)
    return np.where(n > 0, mean, np.nan)


def _long_sum(x: np.ndarray, size: int) -> np.ndarray:
    n, mean, _ = window_moments(x, size)
    return n * mean


LONG_WINDOWS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "max": _extreme(np.fmax),
    "min": _extreme(np.fmin),
    "sum": _long_sum,
    "mean": _long_mean,
    "std": _long_std,
    "rank": _long_rank,
    "median": _long_median,
}


def rolling(fn: str, x: np.ndarray, segments: Segments, size: int, zero: np.ndarray | None = None) -> np.ndarray:
    """``ts_<fn>`` over the last ``size`` rows; ``zero`` marks series whose rank is 0 throughout."""
    zero = segments.all_zero(x) if zero is None and fn == "rank" else zero
    short, full = size <= SHORT, whole(x)
    x = x if full else np.where(np.isfinite(x), x, np.nan)
    if not short:
        out = segments.each(lambda part: LONG_WINDOWS[fn](part, size), x)
    elif full:
        out = shifted(fn, x, segments, size)
        if fn in ("max", "min"):
            return out
    else:
        out = segments.windows(SHORT_WINDOWS[fn], x, size)
    if fn == "rank":
        if short and full:  # alone in its window, a row has no other and rank 0
            out /= segments.shifts(size).ranked
        else:
            others = np.minimum(segments.place, size - 1)
            out = np.where(~np.isnan(x) & (others > 0), out / np.maximum(others, 1), 0.0)
        if np.any(zero):
            out = np.where(segments.spread(zero), 0.0, out)
    return out if whole(out) else np.where(np.isnan(out), 0.0, out)


def momentum(x: np.ndarray, segments: Segments, size: int) -> np.ndarray:
    """Change over a full window; missing when the window is short or has a missing value."""
    x = finite(x)
    first = np.full(len(x), np.nan)
    if size <= len(x):
        first[size - 1 :] = x[: len(x) - size + 1]
    gone = np.concatenate([[0], np.cumsum(np.isnan(x))])
    row = np.arange(len(x))
    whole = (segments.place >= size - 1) & (gone[row + 1] == gone[np.maximum(row - size + 1, 0)])
    change = np.divide(x - first, first, out=np.full(len(x), np.nan), where=(first != 0) & whole)
    return change
