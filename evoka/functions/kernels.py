"""Numpy kernels for one recording, one stack of epochs or one test. Each works
on what one Spark group holds: a recording's channel or a condition's trials."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def butterworth_bandpass(order: int, low: float, high: float, rate: float) -> np.ndarray:
    """Second-order sections (order, 6) of a digital Butterworth band-pass."""
    prototype = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    w1, w2 = (2 * rate * math.tan(math.pi * f / rate) for f in (low, high))
    half = prototype * (w2 - w1) / 2
    root = np.sqrt(half**2 - w1 * w2)
    analog = np.concatenate([half + root, half - root])
    digital = (2 * rate + analog) / (2 * rate - analog)
    upper = sorted(digital[digital.imag > 0], key=lambda p: abs(p))
    sections = np.array([[1.0, 0.0, -1.0, 1.0, -2 * p.real, abs(p) ** 2] for p in upper])
    centre = np.exp(2j * np.arctan(math.sqrt(w1 * w2) / (2 * rate)))
    sections[0, :3] /= abs(response(sections, centre))
    return sections


def response(sections: np.ndarray, z: complex | np.ndarray) -> np.ndarray:
    """Transfer function of the sections at ``z``."""
    out = 1.0 + 0j
    for b0, b1, b2, a0, a1, a2 in sections:
        out = out * (b0 + b1 / z + b2 / z**2) / (a0 + a1 / z + a2 / z**2)
    return out


def _steady(section: np.ndarray) -> tuple[float, float]:
    """State of a section that has seen a constant 1 for ever."""
    b0, b1, b2, _, a1, a2 = section
    gain = (b0 + b1 + b2) / (1 + a1 + a2)
    return gain - b0, b2 - a2 * gain


@lru_cache(maxsize=64)
def _blocks(section: tuple[float, ...], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A section's answer to a block of ``length`` samples: (from samples to
    outputs, from the state before to outputs, from samples to the state after,
    from the state before to that after), from the section's state equations."""
    b0, b1, b2, _, a1, a2 = map(float, section)
    step = np.array([[-a1, 1.0], [-a2, 0.0]])
    drive = np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = np.empty((length + 1, 2, 2))
    powers[0] = np.eye(2)
    for k in range(length):
        powers[k + 1] = powers[k] @ step
    impulse = np.concatenate([[b0], powers[: length - 1, 0] @ drive])
    lag = np.subtract.outer(np.arange(length), np.arange(length))
    return np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0), powers[:length, 0], (powers[:length] @ drive)[::-1], powers[length]


def _filtered(x: np.ndarray, section: np.ndarray, state: np.ndarray, length: int = 128) -> np.ndarray:
    """One section over ``x``, block by block: matrix products for all blocks,
    and a loop over the blocks alone for the state that they hand on."""
    outputs, seen, kept, carried = _blocks(tuple(section), length)
    n = -(-len(x) // length)
    rows = np.concatenate([x, np.zeros(n * length - len(x))]).reshape(n, length)
    given = rows @ kept
    states = np.empty((n, 2))
    for k in range(n):
        states[k] = state
        state = carried @ state + given[k]
    return (rows @ outputs.T + states @ seen.T).ravel()[: len(x)]


def zero_phase(x: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Forward and backward over an odd extension of the ends."""
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]).astype(float)
    for _ in range(2):
        scale, first = 1.0, ext[0]
        for s in sections:
            ext = _filtered(ext, s, np.array(_steady(s)) * first * scale)
            scale *= float(s[:3].sum() / s[3:].sum())
        ext = ext[::-1]
    return ext[pad : len(ext) - pad]


def run_sections(x: np.ndarray, lengths: np.ndarray, sections: np.ndarray, states: np.ndarray, length: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(outputs, states after) of all sections over many series at once. ``x`` has
    them one after another, ``lengths`` of at least 1; ``states`` are a row a series,
    of two numbers a section."""
    # Stretches of ``length`` samples are rows of a matrix; what fills the last
    # one of a series comes after its samples and so changes none of them.
    n = -(-lengths // length)
    row, start = np.cumsum(n) - n, np.cumsum(lengths) - lengths
    at = np.arange(len(x)) + np.repeat(row * length - start, lengths)
    rows = np.zeros((int(n.sum()), length))
    rows.ravel()[at] = x
    order = np.argsort(-n, kind="stable")
    open_ = np.searchsorted(-n[order], -np.arange(n.max(initial=0)))
    last, after = at[start + lengths - 1], np.empty_like(states)
    for k, section in enumerate(sections):
        outputs, seen, kept, carried = _blocks(tuple(section), length)
        own, given, before = states[:, 2 * k : 2 * k + 2], rows @ kept, np.empty((len(rows), 2))
        state = own[order]
        for j, m in enumerate(open_):
            here = row[order[:m]] + j
            before[here] = state[:m]
            state = state[:m] @ carried.T + given[here]
        y = rows @ outputs.T + before @ seen.T
        _, b1, b2, _, a1, a2 = section
        earlier = b2 * rows.ravel()[last - 1] - a2 * y.ravel()[last - 1]
        u, v = rows.ravel()[last], y.ravel()[last]
        after[:, 2 * k] = b1 * u - a1 * v + np.where(lengths > 1, earlier, own[:, 1])
        after[:, 2 * k + 1] = b2 * u - a2 * v
        rows = y
    return rows.ravel()[at], after


def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each of the series that ``x`` has one after another, backward."""
    end = np.cumsum(lengths)
    return x[np.repeat(2 * end - lengths - 1, lengths) - np.arange(len(x))]


def _settled(sections: np.ndarray, value: float) -> np.ndarray:
    """State of the sections after a constant ``value`` for ever."""
    scale, out = float(value), []
    for s in sections:
        out += [scale * part for part in _steady(s)]
        scale *= float(s[:3].sum() / s[3:].sum())
    return np.array(out)


def zero_phase_summaries(x: np.ndarray, lengths: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each block's part in the states that it hands on, from no state: forward
    over the block, and backward over what that gives. ``x`` has the blocks one
    after another."""
    none = np.zeros((len(lengths), 2 * len(sections)))
    y, after = run_sections(x, lengths, sections, none)
    return after, run_sections(_turned(y, lengths), lengths, sections, none)[1]


def zero_phase_summary(x: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One block's summary."""
    ahead, behind = zero_phase_summaries(x, np.array([len(x)]), sections)
    return ahead[0], behind[0]


def _passing(sections: np.ndarray):
    """Function of a length n: (what n samples leave of a state before them, what
    that state hands on when its outputs are run over backward)."""
    size = 2 * len(sections)
    step, drive, out, straight = np.zeros((size, size)), np.zeros(size), np.zeros(size), 1.0
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        own = slice(2 * k, 2 * k + 2)
        into = np.array([b1 - a1 * b0, b2 - a2 * b0])
        step[own, :] += np.outer(into, out)
        step[own, own] += np.array([[-a1, 1.0], [-a2, 0.0]])
        drive[own] = into * straight
        out, straight = b0 * out, b0 * straight
        out[2 * k] += 1.0
    known = {0: (np.eye(size), np.zeros((size, size))), 1: (step, np.outer(drive, out))}

    def of(n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in known:
            (m, h), (m2, h2) = of(n // 2), of(n - n // 2)
            known[n] = m @ m2, h + m @ h2 @ m
        return known[n]

    return of


def zero_phase_pad(sections: np.ndarray, n: int) -> int:
    return min(3 * (2 * len(sections) + 1), n - 1)


def all_zero_phase_states(blocks: np.ndarray, lengths: np.ndarray, heads: tuple[np.ndarray, np.ndarray], tails: tuple[np.ndarray, np.ndarray], ahead: np.ndarray, behind: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States before each block of many series, forward and backward. ``blocks``
    counts each series' blocks, which the others have one after another: lengths,
    summaries, and (values, numbers of them) of the first and last samples of the
    blocks, as many as the padding and one more, or all. Series have two samples
    or more."""
    start, of = np.cumsum(blocks) - blocks, _passing(sections)
    pad = np.minimum(zero_phase_pad(sections, 10**9), np.add.reduceat(lengths, start) - 1)
    (first, n_first), (last, n_last) = heads, tails
    # Heads in a row begin as the series does, and tails in a row end as it does.
    begin = (np.cumsum(n_first) - n_first)[start]
    end = np.cumsum(n_last)[start + blocks - 1] - 1
    each = np.arange(pad.sum()) - np.repeat(np.cumsum(pad) - pad, pad)
    front = np.repeat(2 * first[begin], pad) - first[np.repeat(begin + pad, pad) - each]
    rear = np.repeat(2 * last[end], pad) - last[np.repeat(end, pad) - 1 - each]
    at, settled = np.cumsum(pad) - pad, _settled(sections, 1.0)
    state = run_sections(front, pad, sections, np.outer(front[at], settled))[1]

    unique, which = np.unique(lengths, return_inverse=True)
    left, turned = (np.stack(m) for m in zip(*(of(int(n)) for n in unique), strict=True))
    times = lambda m, here, v: np.einsum("sij,sj->si", m[which[here]], v)
    forward, backward = np.empty_like(ahead), np.empty_like(ahead)
    for k in range(blocks.max()):
        on = np.flatnonzero(blocks > k)
        here = start[on] + k
        forward[here] = state[on]
        state[on] = times(left, here, state[on]) + ahead[here]
    # The padding at the end, filtered, is where the way back begins.
    rear = _turned(run_sections(rear, pad, sections, state)[0], pad)
    state = run_sections(rear, pad, sections, np.outer(rear[at], settled))[1]
    for k in range(blocks.max()):
        on = np.flatnonzero(blocks > k)
        here = start[on] + blocks[on] - 1 - k
        backward[here] = state[on]
        state[on] = times(left, here, state[on]) + behind[here] + times(turned, here, forward[here])
    return forward, backward


def zero_phase_states(lengths: list[int], heads: list, tails: list, ahead: list, behind: list, sections: np.ndarray) -> tuple[list, list]:
    """One series' states before its blocks."""
    ends = [(np.concatenate([*own]).astype(float), np.array([len(x) for x in own])) for own in (heads, tails)]
    forward, backward = all_zero_phase_states(np.array([len(lengths)]), np.array(lengths), *ends, np.array(ahead), np.array(behind), sections)
    return list(forward), list(backward)


def zero_phase_blocks(x: np.ndarray, lengths: np.ndarray, sections: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Blocks filtered from the states before them; ``x`` has them one after another."""
    y, _ = run_sections(x, lengths, sections, forward)
    return _turned(run_sections(_turned(y, lengths), lengths, sections, backward)[0], lengths)


def zero_phase_block(x: np.ndarray, sections: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """One block filtered."""
    return zero_phase_blocks(x, np.array([len(x)]), sections, forward[None], backward[None])


def welch(x: np.ndarray, rate: float, n_segment: int, n_overlap: int, n_fft: int | None = None, detrend: str = "constant") -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, one-sided densities) of the last axis: mean of periodograms
    with a periodic Hann window; a last piece shorter than a segment isn't used."""
    n_segment = min(n_segment, x.shape[-1])
    n_fft = n_fft or n_segment
    step = n_segment - min(n_overlap, n_segment - 1)
    pieces = np.lib.stride_tricks.sliding_window_view(x, n_segment, axis=-1)[..., ::step, :].astype(float)
    pieces = pieces - pieces.mean(axis=-1, keepdims=True)
    if detrend == "linear":
        t = np.arange(n_segment) - (n_segment - 1) / 2
        pieces = pieces - (pieces @ t / (t @ t))[..., None] * t
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_segment) / n_segment)
    power = np.abs(np.fft.rfft(pieces * window, n_fft)) ** 2 / (rate * (window @ window))
    power[..., 1 : (-1 if n_fft % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(n_fft, 1 / rate), power.mean(axis=-2)


def smoothing_length(seconds: float, rate: float, n: int, order: int) -> int:
    """An odd window of about ``seconds``, longer than the order, within ``n``."""
    length = max(round(seconds * rate), order + 2)
    length += 1 - length % 2
    most = n if n % 2 else n - 1
    return min(length, most)


def savgol_matrix(n: int, length: int, order: int) -> np.ndarray:
    """The smoother as an (n, n) matrix; at the edges the polynomial of the
    outermost window is evaluated."""
    half = length // 2
    powers = np.vander(np.arange(-half, half + 1, dtype=float), order + 1, increasing=True)
    hat = powers @ np.linalg.pinv(powers)
    out = np.zeros((n, n))
    for i in range(n):
        start = min(max(0, i - half), n - length)
        out[i, start : start + length] = hat[i - start]
    return out


def huber_location(stack: np.ndarray, c: float, iterations: int, tolerance: float, mad_scale: float) -> np.ndarray:
    """Robust mean over the first axis. The scale is fixed at the start, cells
    without spread borrow the median scale of the others, and all cells stop
    together when none moves by ``tolerance``."""
    if len(stack) < 2:
        raise ValueError("fewer than two trials")
    centre = np.median(stack, axis=0)
    scale = mad_scale * np.median(np.abs(stack - centre), axis=0)
    positive = scale[scale > 1e-10]
    scale = np.where(scale > 1e-10, scale, np.median(positive) if positive.size else 1.0)
    for _ in range(iterations):
        z = np.abs(stack - centre) / scale
        weight = np.minimum(1.0, c / np.maximum(z, 1e-300))
        moved = (weight * stack).sum(axis=0) / weight.sum(axis=0)
        done = np.max(np.abs(moved - centre)) < tolerance
        centre = moved
        if done:
            break
    return centre


#: Numpy's hypergeometric draws end at so many rows.
MOST_ROWS = 10**9


def _log_left(n: float, k: np.ndarray) -> np.ndarray:
    """log of n! / (n - k)! / n^k for large n; steady where n is far over 10^9."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = -(n - k + 0.5) * np.log1p(-k / n) - k + (1 / n - 1 / (n - k)) / 12
    return np.where(k < n, out, -np.inf)


def hypergeometric(good: int, bad: int, n: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each of ``n`` how many of that many rows, drawn without replacement,
    are of the ``good`` ones.

    Beyond the numbers that numpy draws, draws with replacement are accepted with
    the ratio of both probabilities, which is log-concave and at most the root of 2
    while no more than half of all rows are drawn; of more, those left are drawn."""
    n = np.asarray(n, np.int64)
    total = good + bad
    if total < MOST_ROWS:
        return rng.hypergeometric(good, bad, n)
    if not good or not bad:
        return n if not bad else np.zeros_like(n)
    few = np.minimum(n, total - n)
    out, open_ = np.zeros_like(n), np.flatnonzero(few)
    ratio = lambda x, k: _log_left(good, x) + _log_left(bad, k - x) - _log_left(total, k)
    while len(open_):
        k = few[open_].astype(float)
        x = rng.binomial(few[open_], good / total)
        fits = (x <= good) & (few[open_] - x <= bad)
        chance = np.where(fits, ratio(np.minimum(x, good).astype(float), k) - ratio(k * (good / total), k), -np.inf)
        taken = np.log(rng.random(len(x))) <= chance
        out[open_[taken]] = x[taken]
        open_ = open_[~taken]
    return np.where(2 * n > total, good - out, out)


def _parted(counts: np.ndarray, n: np.ndarray, split) -> np.ndarray:
    """(draws, values): ``n`` rows dealt to values that occur ``counts`` times, by
    halves of the values; ``split(low, high, n)`` deals between two halves."""
    if len(counts) == 1:
        return n[:, None]
    half = len(counts) // 2
    low, high = counts[:half], counts[half:]
    first = split(int(low.sum()), int(high.sum()), n)
    return np.concatenate([_parted(low, first, split), _parted(high, n - first, split)], axis=1)


#: With up to so many rows per distinct value, rows are drawn; with more, counts.
FEW_TIES = 4
#: Binomial draws of up to so many rows are looked up in a table.
TABLED = 128
#: Numbers that replicates draw at once.
AT_ONCE = 50_000


def _binomials(counts: np.ndarray, p: float, rows: int, rng: np.random.Generator) -> np.ndarray:
    """(rows, values): binomial draws of ``counts``, all with the chance ``p``."""
    if p > 0.5:
        return counts - _binomials(counts, 1 - p, rows, rng)
    out = np.empty((rows, len(counts)), np.int64)
    for c in np.unique(counts).tolist():
        at = np.flatnonzero(counts == c)
        if c > TABLED:
            out[:, at] = rng.binomial(c, p, (rows, len(at)))
            continue
        k, u = np.arange(c), rng.random((rows, len(at)))
        below = np.cumsum((1 - p) ** c * np.cumprod([1.0, *((c - k[:-1]) / (k[:-1] + 1) * (p / (1 - p)))]))
        out[:, at] = u >= below[0] if c == 1 else np.searchsorted(below, u.ravel(), side="right").reshape(u.shape)
    return out


def _sums_of_picked(v: np.ndarray, rows: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The sum of ``n`` of each line's ``rows`` by value, without replacement."""
    total = rows.sum(axis=1)
    # Places among all lines' rows, drawn until ``few`` of a line's are unlike.
    few, last = np.minimum(n, total - n), np.cumsum(total)
    places, need = np.empty(0, np.int64), few
    while need.any():
        line = np.repeat(np.arange(len(n)), need)
        places = np.unique(np.concatenate([places, last[line] - 1 - rng.integers(0, total[line])]))
        need = few - np.bincount(np.searchsorted(last, places, side="right"), minlength=len(n))
    at = np.searchsorted(np.cumsum(rows.ravel()), places, side="right")
    sums = np.bincount(at // len(v), v[at % len(v)], minlength=len(n))
    rest = few < n
    if rest.any():
        sums[rest] = rows[rest].astype(float) @ v - sums[rest]
    return sums


def _sums_of_some(v: np.ndarray, counts: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each of ``n`` the sum of that many rows, drawn without replacement.

    Each row is drawn or not by itself; then as many are given back or drawn from
    those left as the number asks for, which leaves all choices of ``n`` rows equally
    likely. These are about the root of the rows; where that is far more than the
    values, counts are dealt by halves."""
    total = int(counts.sum())
    if total > (3 * len(v)) ** 2:
        return _parted(counts, n, lambda low, high, k: hypergeometric(low, high, k, rng)) @ v
    # Few replicates at once, since arrays that stay in the cache cost a fraction.
    out, some = np.empty(len(n)), max(1, AT_ONCE // len(v))
    for at in range(0, len(n), some):
        wanted = n[at : at + some]
        drawn = _binomials(counts, float(n.mean()) / total, len(wanted), rng)
        over = drawn.sum(axis=1) - wanted
        sums = drawn.astype(float) @ v
        for sign, here in ((-1, over > 0), (1, over < 0)):
            if here.any():
                sums[here] += sign * _sums_of_picked(v, drawn[here] if sign < 0 else counts - drawn[here], np.abs(over[here]), rng)
        out[at : at + some] = sums
    return out


def _sums_of_repeated(v: np.ndarray, counts: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each of ``n`` the sum of that many rows, drawn with replacement."""
    total = int(counts.sum())
    if total > FEW_TIES * len(v):
        return _parted(counts, n, lambda low, high, k: rng.binomial(k, low / max(1, low + high))) @ v
    rows = np.repeat(v, counts)
    return np.array([rows[rng.integers(0, total, int(k))].sum() if k else 0.0 for k in n])


def _share(path: np.ndarray, block: int, n: np.ndarray, repeated: bool, seed: list[int]) -> np.ndarray:
    """How many of ``n`` rows of the whole fall to a block: from the root of a
    binary tree of blocks, each node deals its rows to its halves. ``path`` has the
    (level, low, high) rows of the block's own nodes; a node's draws come from its
    seed, so all blocks below it see the same ones."""
    for level, low, high in path.tolist():
        rng = np.random.default_rng([*seed, level, block >> level])
        first = rng.binomial(n, low / max(1, low + high)) if repeated else hypergeometric(low, high, n, rng)
        n = n - first if block >> (level - 1) & 1 else first
    return n


def block_sums(v: np.ndarray, left: np.ndarray, right: np.ndarray, block: int, path: np.ndarray, n_left: int, n_right: int, n_permutations: int, n_bootstraps: int, seed: list[int]) -> tuple[list, list, list]:
    """A block's part in the replicates of a test: sums of the values that each
    exchange of labels gives to the left, and of those that each bootstrap draws
    again from either side. ``v`` are distinct values, ``left`` and ``right`` how
    often they occur; ``path`` has the nodes over the block as rows (level, left
    rows of the low half, of the high half, right rows of both), the root first."""
    rng, level = np.random.default_rng([*seed, 3, block]), path[:, :1]
    permuted, drawn = [], [[], []]
    if n_permutations:
        both = np.hstack([level, path[:, 1:3] + path[:, 3:5]])
        permuted = _sums_of_some(v, left + right, _share(both, block, np.full(n_permutations, n_left), False, [*seed, 0]), rng).tolist()
    for j, (counts, total) in enumerate(((left, n_left), (right, n_right)) if n_bootstraps else ()):
        own = _share(np.hstack([level, path[:, 1 + 2 * j : 3 + 2 * j]]), block, np.full(n_bootstraps, total), True, [*seed, 1 + j])
        drawn[j] = _sums_of_repeated(v, counts, own, rng).tolist() if counts.any() else [0.0] * n_bootstraps
    return permuted, *drawn


def cell_accuracy(cells: np.ndarray) -> np.ndarray:
    """Balanced accuracy of counts (..., 4) in order (truth, guess) = 00, 01, 10,
    11; a class without rows has no part in it."""
    c = cells.astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        parts = np.stack([c[..., 0] / (c[..., 0] + c[..., 1]), c[..., 3] / (c[..., 2] + c[..., 3])])
    known = ~np.isnan(parts)
    return np.where(known.any(axis=0), np.where(known, parts, 0).sum(axis=0) / np.maximum(1, known.sum(axis=0)), np.nan)


def permuted_accuracies(strata: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Balanced accuracies of ``n`` exchanges of truths within strata (s, 4)."""
    total = np.zeros((n, 4), np.int64)
    for t00, t01, t10, t11 in strata.tolist():
        # Of the rows guessed 0, how many get a truth of 0.
        a = rng.hypergeometric(t00 + t01, t10 + t11, t00 + t10, n) if t00 + t10 else np.zeros(n, np.int64)
        total += np.stack([a, t00 + t01 - a, t00 + t10 - a, t11 + t01 - (t00 + t01 - a)], axis=1)
    return cell_accuracy(total)


def bootstrapped_accuracies(strata: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Balanced accuracies of ``n`` draws with replacement within strata (s, 4)."""
    total = np.zeros((n, 4), np.int64)
    for cells in strata:
        if cells.sum():
            total += rng.multinomial(int(cells.sum()), cells / cells.sum(), n)
    return cell_accuracy(total)


def balanced_accuracy(truth: np.ndarray, guess: np.ndarray) -> float:
    parts = [(guess[truth == k] == k).mean() for k in (0, 1) if (truth == k).any()]
    return float(np.mean(parts)) if parts else float("nan")


def anova_f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Two-group F of each column; 0 where the groups have no spread."""
    a, b = x[y == 0], x[y == 1]
    grand = x.mean(axis=0)
    between = len(a) * (a.mean(axis=0) - grand) ** 2 + len(b) * (b.mean(axis=0) - grand) ** 2
    inside = ((a - a.mean(axis=0)) ** 2).sum(axis=0) + ((b - b.mean(axis=0)) ** 2).sum(axis=0)
    return np.where(inside > 0, between / np.where(inside > 0, inside, 1.0) * (len(x) - 2), 0.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Weights and, last, an intercept that is penalised too; classes weigh
    alike. ``penalty`` is the inverse strength, as C."""
    s = np.where(y == 1, 2 * y - 1, -1.0)
    weight = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(s * (z @ w), -500, 500)))
        gradient = w - penalty * z.T @ (weight * s * p)
        hessian = np.eye(len(w)) + penalty * (z * (weight * p * (1 - p))[:, None]).T @ z
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return w


def stratified_folds(y: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Fold number of each row; a class is dealt to folds in sizes that differ
    by one at most."""
    fold = np.zeros(len(y), np.int64)
    for value in np.unique(y):
        at = rng.permutation(np.flatnonzero(y == value))
        fold[at] = np.arange(len(at)) % k
    return fold
