"""The full match of whole batches of runs: items as flat columns, every step for all runs of a batch at once.

The rules and their numbers are those of the column steps of ``matching`` (places, vertical slots, bundle slots, offset, lines, pairs).
As windows they sort the items about ten times, each with its own order; here a batch of whole runs is sorted in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gaugeline import constants as K
from gaugeline.operators.stacks import before, median

#: Columns of an item; ``top``, ``bottom`` and ``told`` are of its set.
ITEM = [
    "run_id", "side", "active", "unmatched", "y_center", "box_height", "source_order", "tube_idx", "id", "distance_in", "relative_position", "notes", "model_source",
    "top", "bottom", "told",
]
STATUS = ["matched", "left_only", "right_only", "left_only_manual", "right_only_manual"]
MATCHED, LEFT, RIGHT, LEFT_MANUAL, RIGHT_MANUAL = range(5)
#: Items that are worked on together; a run is never cut.
CHUNK = 1 << 16


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Whether a row begins a new group of neighbouring rows with equal values."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def place_in(new: np.ndarray) -> np.ndarray:
    """Places from 0 in groups that begin where ``new`` is set."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def run_sums(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Running sums in groups that begin where ``new`` is set."""
    total = np.cumsum(values)
    return total - np.repeat((total - values)[new], np.diff(np.append(np.flatnonzero(new), len(new))))


def numbers(column: pa.Array, unknown: float = np.nan) -> np.ndarray:
    return pc.fill_null(column.cast(pa.float64()), unknown).to_numpy(zero_copy_only=False)


def truth(column: pa.Array, unknown: bool = False) -> np.ndarray:
    return pc.fill_null(column, unknown).to_numpy(zero_copy_only=False).astype(bool)


def codes(column: pa.Array, first: tuple[str, ...] = ()) -> np.ndarray:
    """Whole numbers for texts: those of ``first`` in their order, the others behind; null is one of these."""
    column = column.cast(pa.string()).dictionary_encode()
    words = column.dictionary.to_pylist()
    of = np.array([first.index(w) if w in first else len(first) + i for i, w in enumerate(words)] + [len(first) + len(words)])
    return of[pc.fill_null(column.indices, len(words)).to_numpy(zero_copy_only=False)]


def attached(slot: np.ndarray, queue: np.ndarray, side: np.ndarray) -> np.ndarray:
    """False for top items that stand four or more slots above the rest."""
    order = np.lexsort((queue, slot, side))
    at, of = place_in(starts_of(side[order])), side[order]
    step = slot[order] - before(slot[order], of)
    anchored = np.isnan(step) | (step < K.DETACHED_TOP_GAP)
    last = np.zeros(side.max(initial=-1) + 1, np.int64)
    last[of[anchored]] = at[anchored]  # the last one counts
    stays = np.zeros(len(slot), bool)
    stays[order] = at <= last[of]
    return stays


def vertical_slots(y, box_height, place, has_y, side, n) -> np.ndarray:
    """Slots counted from the bottom up; items without y keep their place."""
    gap = np.where(has_y, np.abs(y - before(y, side)), np.nan)
    raw = median(gap, side, n)
    pitch = median(gap, side, n, (gap >= 0.45 * raw[side]) & (gap <= 1.85 * raw[side]))
    pitch = np.where(np.isnan(pitch), raw, pitch)
    order = np.lexsort((place, -y, side))
    of, low, up = side[order], before(box_height[order], side[order]), box_height[order]
    has_low, has_up = low > 1e-6, up > 1e-6
    local = 1.05 * np.where(has_low & has_up, 0.5 * (low + up), np.where(has_low, low, np.where(has_up, up, np.nan)))
    expected = np.where(pitch[of] > 1e-6, np.fmax(local, pitch[of]), local)
    ratio = np.abs(before(y[order], of) - y[order]) / np.where(expected > 1e-6, expected, np.nan)
    step = np.where(ratio >= K.SLOT_RATIO_LIMIT, np.maximum(1, np.rint(ratio)), 1.0)
    slot = place.astype(float)
    usable = has_y[order] & (pitch[of] > 1e-6)
    slot[order] = np.where(usable, run_sums(step, starts_of(of)), slot[order])
    return slot


def bundle_slots(y, top, bottom, place, side, n) -> np.ndarray:
    """Slots from the position between the bounds of the bundle; NaN without bounds."""
    share = np.fmax(0.0, np.fmin(1.0, (bottom - y) / np.where(bottom - top > 1e-6, bottom - top, np.nan)))
    order = np.lexsort((place, share, side))
    of, gap = side[order], share[order] - before(share[order], side[order])
    raw = median(gap, of, n)
    pitch = median(gap, of, n, (gap >= 0.35 * raw[of]) & (gap <= 2.25 * raw[of]))
    pitch = np.where(np.isnan(pitch), raw, pitch)
    pitch = np.where(pitch > 1e-6, pitch, np.nan)
    return np.maximum(1, np.rint(share / pitch[side]) + 1)


def best_offsets(run, side, slot, n) -> np.ndarray:
    """Per run, the shift of the right slots that fits the left slots best."""
    known = ~np.isnan(slot)
    key = lambda s: np.unique((run[known & (side == s)] << 40) + slot[known & (side == s)].astype(np.int64))
    left, right = key(0), key(1)
    of_left, of_right = left >> 40, right >> 40
    many = [np.bincount(of, minlength=n) for of in (of_left, of_right)]
    least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(least, of_left, left)
    np.maximum.at(most, of_left, left)
    best = None
    for shift in sorted({*K.SLOT_OFFSETS, K.RIGHT_SLOT_HINT - 1, K.RIGHT_SLOT_HINT, K.RIGHT_SLOT_HINT + 1}):
        moved = right + shift
        matched = np.bincount(of_right[np.isin(moved, left, assume_unique=True)], minlength=n)
        outside = np.bincount(of_right[(moved > most[of_right]) | (moved < least[of_right])], minlength=n)
        score = [matched, 2 * matched - many[0] - many[1], -outside, np.full(n, -abs(shift)), np.full(n, -shift)]
        if best is None:
            best = score
            continue
        better, equal = np.zeros(n, bool), np.ones(n, bool)
        for new, old in zip(score, best):
            better |= equal & (new > old)
            equal &= new == old
        best = [np.where(better, new, old) for new, old in zip(score, best)]
    return np.where((many[0] > 0) & (many[1] > 0), -best[-1], 0)


def common(run, side, where, n, *keys) -> np.ndarray:
    """Per run, how many keys both sides have; a side has a key once."""
    which = np.flatnonzero(where & (side < 2))
    order = which[np.lexsort((side[which], *[k[which] for k in reversed(keys)], run[which]))]
    again = ~starts_of(run[order], *[k[order] for k in keys])
    return np.bincount(run[order][again], minlength=n)


def match(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """(match rows, one header row per run) of whole runs, whose rows are neighbours."""
    run = np.cumsum(starts_of(codes(rows.column("run_id")))) - 1
    n, side = int(run[-1]) + 1, codes(rows.column("side"), ("151", "152"))
    sides = int(side.max()) + 1
    names = rows.column("run_id").take(pa.array(np.searchsorted(run, np.arange(n))))
    # what is known of a side from any of its items, active or not
    of_side = run * sides + side
    told = np.bincount(of_side[truth(rows.column("model_source")) | truth(rows.column("told"))], minlength=n * sides) > 0
    top, bottom = numbers(rows.column("top")), numbers(rows.column("bottom"))
    low_first = lambda v: np.where(np.isnan(v), -np.inf, v)
    by_bounds = np.lexsort((low_first(bottom), low_first(top), of_side))
    largest = np.full(n * sides, -1)
    largest[of_side[by_bounds]] = by_bounds  # the last one counts

    active = np.flatnonzero(truth(rows.column("active")))
    y, key_side = numbers(rows.column("y_center")), of_side
    has_y = (np.bincount(of_side[active][np.isnan(y[active])], minlength=n * sides) == 0)[of_side]
    first = np.where(has_y, y, numbers(rows.column("source_order"), -np.inf))
    index = numbers(rows.column("tube_idx"), -np.inf)
    order = active[np.lexsort((index[active], first[active], key_side[active]))]
    if not starts_of(key_side[order], first[order], index[order]).all():
        rank = pc.rank(rows.column("id"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = active[np.lexsort((rank[active], index[active], first[active], key_side[active]))]
    run, side, y, has_y, of_side = run[order], side[order], y[order], has_y[order], of_side[order]
    new = starts_of(of_side)
    place, group = place_in(new) + 1, np.cumsum(new) - 1
    groups = int(new.sum())
    unmatched, plain = truth(rows.column("unmatched"))[order], ~truth(rows.column("unmatched"), True)[order]

    v_slot = vertical_slots(y, numbers(rows.column("box_height"))[order], place, has_y, group, groups)
    v_slot = np.where(attached(v_slot, -place, group), v_slot, np.nan)
    own = largest[of_side]
    b_slot = bundle_slots(y, top[own], bottom[own], place, group, groups)
    b_slot = np.where(attached(b_slot, place, group), b_slot, np.nan)
    has = lambda s: np.bincount(run[(side == s) & ~np.isnan(b_slot)], minlength=n) > 0
    bundle = has(0) & has(1)
    slot, queue = np.where(bundle[run], b_slot, v_slot), np.where(bundle[run], place, -place)

    line = np.lexsort((queue, slot, group))
    begins = starts_of(group[line], slot[line])
    turn, alone = np.zeros(len(run), np.int64), np.zeros(len(run), np.int64)
    turn[line] = run_sums((~unmatched[line]).astype(np.int64), begins) + unmatched[line]
    alone[line] = np.where(unmatched[line], place_in(begins) + 1, 0)
    phase = np.where(plain, 2, np.where(side == 0, 0, 1))

    offset = best_offsets(run, side, slot, n)
    counts = [np.bincount(run[side == s], minlength=n) for s in (0, 1)]
    moved = slot + np.where(side == 1, offset[run], 0)
    slot_matched = common(run, side, ~np.isnan(slot) & (phase == 2), n, moved, turn)
    order_matched = common(run, side, ~unmatched, n, place)
    fewer, more = np.minimum(*counts), np.maximum(*counts)
    count_ratio = fewer / np.maximum(more, 1)
    modelled = told[np.arange(n) * sides] & (told[np.arange(n) * sides + 1] if sides > 1 else False)
    use_order = modelled & (fewer >= K.ORDER_MIN_COUNT) & (count_ratio >= K.ORDER_MIN_RATIO) & (order_matched > slot_matched)
    strategy = pa.array([K.STRATEGY_SLOTS, K.STRATEGY_ORDER, K.STRATEGY_BUNDLE, K.STRATEGY_BUNDLE_ORDER]).take(pa.array(2 * bundle + use_order))

    by_order = use_order[run]
    taken = np.flatnonzero(by_order | ~np.isnan(slot))
    by_order, run, side = by_order[taken], run[taken], side[taken]
    key = np.where(by_order, place[taken], -moved[taken])
    turn, phase, alone = (np.where(by_order, 0, c[taken]) for c in (turn, phase, alone))
    sort = np.lexsort((side, alone, phase, turn, key, run))
    begins = starts_of(run[sort], key[sort], turn[sort], phase[sort], alone[sort])
    pair = np.cumsum(begins) - 1
    heads = sort[begins]
    run, by_order, phase = run[heads], by_order[heads], phase[heads]
    item = [np.full(len(heads), -1), np.full(len(heads), -1)]
    for s in (0, 1):
        item[s][pair[side[sort] == s]] = taken[sort[side[sort] == s]]
    aside = [(i >= 0) & unmatched[i] if len(unmatched) else i >= 0 for i in item]
    both = np.where((item[0] >= 0) & (item[1] >= 0), MATCHED, np.where(item[0] >= 0, LEFT, RIGHT))
    hand = [np.where(by_order, aside[0], phase == 0), np.where(by_order, aside[1] & ~aside[0], phase == 1)]
    status = np.where(hand[0], LEFT_MANUAL, np.where(hand[1], RIGHT_MANUAL, both))
    item[0] = np.where(by_order & (status == RIGHT_MANUAL), -1, item[0])
    item[1] = np.where(by_order & (status == LEFT_MANUAL), -1, item[1])

    of = [pa.array(order[i] if len(order) else i, mask=i < 0) for i in item]
    value = lambda s, c: rows.column(c).take(of[s])
    matched = {
        "run_id": names.take(pa.array(run)), "tube_number": pa.array(place_in(starts_of(run)) + 1, pa.int32()), "match_status": pa.array(STATUS).take(pa.array(status)),
        "id_151": value(0, "id"), "id_152": value(1, "id"), "tube_idx_151": value(0, "tube_idx"), "measurement_151": value(0, "distance_in"),
        "tube_idx_152": value(1, "tube_idx"), "measurement_152": value(1, "distance_in"), "r152_position": value(1, "relative_position"),
        "notes_151": value(0, "notes"), "notes_152": value(1, "notes"), "strategy": strategy.take(pa.array(run)),
    }
    header = {
        "run_id": names, "n151": pa.array(counts[0]), "n152": pa.array(counts[1]), "slot_matched": pa.array(slot_matched), "order_matched": pa.array(order_matched),
        "bundle": pa.array(bundle), "count_ratio": pa.array(count_ratio), "strategy": strategy,
    }
    return tuple(pa.RecordBatch.from_arrays(list(columns.values()), list(columns)) for columns in (matched, header))


def whole_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` that end where a run ends; rows of a run are neighbours."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size < most:
            held.append(batch)
            size += batch.num_rows
            continue
        # enough is held: it goes up to the first change of the run
        before_it, ids = held[-1].column("run_id")[-1], batch.column("run_id")
        new = np.flatnonzero(np.concatenate(([True], starts_of(codes(ids))[1:])))
        cut = 0 if ids[0] != before_it and (ids[0].is_valid or before_it.is_valid) else int(new[1]) if len(new) > 1 else batch.num_rows
        held.append(batch.slice(0, cut))
        if cut < batch.num_rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [batch.slice(cut)], batch.num_rows - cut
        else:
            size += cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def matcher(part: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over items whose runs are neighbours: the match rows (part 0) or the headers (part 1)."""

    most = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, most):
            with np.errstate(invalid="ignore", divide="ignore"):
                yield match(rows)[part].select(names)

    return run
