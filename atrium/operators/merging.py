"""The greedy merging rule on arrays, for many groups of segments at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _angles(s: np.ndarray) -> np.ndarray:
    deg = np.degrees(np.arctan2(s[:, 3] - s[:, 1], s[:, 2] - s[:, 0]))
    return np.where(deg < 0, deg + 180, deg)


def _fits(grown: np.ndarray, turned: np.ndarray, others: np.ndarray, others_turned: np.ndarray, cfg) -> np.ndarray:
    """Which of ``others`` the grown segment beside each may take up."""
    turn = np.abs(turned - others_turned)
    ok = np.minimum(turn, 180 - turn) <= cfg.angle_deg
    gaps = [np.hypot(grown[:, i] - others[:, j], grown[:, i + 1] - others[:, j + 1]) for i in (0, 2) for j in (0, 2)]
    ok &= np.minimum.reduce(gaps) <= cfg.distance
    if cfg.perpendicular is None:
        return ok
    x1, y1, x2, y2 = grown.T
    mx, my = (others[:, 0] + others[:, 2]) / 2, (others[:, 1] + others[:, 3]) / 2
    size = np.hypot(x2 - x1, y2 - y1)
    across = np.abs((y2 - y1) * mx - (x2 - x1) * my + x2 * y1 - y2 * x1) / np.where(size < 1e-12, 1, size)
    return ok & (np.where(size < 1e-12, np.hypot(mx - x1, my - y1), across) <= cfg.perpendicular)


def _joined(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The two ends farthest apart of each pair of segments; the first of equals."""
    ends = np.stack([s[:, :2], s[:, 2:], t[:, :2], t[:, 2:]], axis=1)
    i, j = np.triu_indices(4, 1)
    far = np.argmax(np.hypot(*np.moveaxis(ends[:, i] - ends[:, j], 2, 0)), axis=1)
    row = np.arange(len(s))
    return np.concatenate([ends[row, i[far]], ends[row, j[far]]], axis=1)


def _one_pass(now: np.ndarray, group: np.ndarray, n_groups: int, cfg) -> tuple[np.ndarray, np.ndarray]:
    """Segments after one pass over groups sorted and numbered from 0, and the places of those that they have grown from.

    All groups go in step: in each the first segment left grows by the next later one that fits it, or is done and gives
    way to the next one left.
    """
    n = len(now)
    turned, out, taken = _angles(now), now.copy(), np.zeros(n, dtype=bool)
    seed = np.searchsorted(group, np.arange(n_groups))  # what grows in each group, and the last place it has looked at
    last, active, seeds = seed.copy(), np.ones(n_groups, dtype=bool), [seed.copy()]
    left = np.flatnonzero(np.arange(n) != seed[group])
    while active.any():
        look = left[left > last[group[left]]]
        grown, g = out[seed], group[look]
        hits = look[_fits(grown[g], _angles(grown)[g], now[look], turned[look], cfg)]
        first = np.ones(len(hits), dtype=bool)
        first[1:] = group[hits[1:]] != group[hits[:-1]]
        hits = hits[first]
        grew = group[hits]
        out[seed[grew]] = _joined(out[seed[grew]], now[hits])
        taken[hits], last[grew] = True, hits
        left = left[~taken[left]]
        following = np.full(n_groups, n)
        following[group[left[::-1]]] = left[::-1]
        rests = active.copy()
        rests[grew] = False
        active[rests & (following == n)] = False
        on = rests & (following < n)
        seed[on] = last[on] = following[on]
        seeds.append(seed[on])
        left = left[active[group[left]] & (left != seed[group[left]])]
    order = np.sort(np.concatenate(seeds))
    return out[order], order


def merge(segments: np.ndarray, group: np.ndarray, cfg) -> tuple[np.ndarray, np.ndarray]:
    """Merged segments ``(x1, y1, x2, y2)`` and the place of the first of each, for groups numbered in order."""
    place, kept, places = np.arange(len(segments)), [], []
    now = segments
    while len(now):
        names, dense = np.unique(group, return_inverse=True)
        merged, order = _one_pass(now, dense, len(names), cfg)
        before, after = np.bincount(dense, minlength=len(names)), np.bincount(dense[order], minlength=len(names))
        settled = (before == after)[dense[order]] if cfg.until_stable else np.ones(len(order), dtype=bool)
        kept.append(merged[settled])
        places.append(place[order][settled])
        now, place, group = merged[~settled], place[order][~settled], group[order][~settled]
    if not kept:
        return segments, place
    found, places = np.concatenate(kept), np.concatenate(places)
    order = np.argsort(places, kind="stable")
    return found[order], places[order]


def merge_batches(batches: Iterator[pa.RecordBatch], cfg) -> Iterator[pa.RecordBatch]:
    """Merged segments of rows ``(plan_id, floor_id, rows)`` with a group's segments in order; ``seg_id`` is that of the first."""
    for batch in batches:
        lists = batch.column(2)
        group = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        rows = lists.flatten()
        segments = np.stack([rows.field(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1) if len(rows) else np.zeros((0, 4))
        found, place = merge(segments, group, cfg)
        at, owner = pa.array(place), pa.array(group[place])
        columns = [batch.column(0).take(owner), batch.column(1).take(owner), rows.field("seg_id").take(at), *[pa.array(np.ascontiguousarray(found[:, i])) for i in range(4)]]
        yield pa.RecordBatch.from_arrays(columns, names=["plan_id", "floor_id", "seg_id", "x1", "y1", "x2", "y2"])
