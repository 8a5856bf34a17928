"""Whole batches of spectra at once: order, masking and comparison of their arrays in numpy.

Arrow lists are handled as one flat array with offsets, so nothing is done value by value in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spectra that are handled at once.
ROWS = 256


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values as doubles, offsets from 0, which lists are null) of a list column; null values are NaN."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.float64()).to_numpy(zero_copy_only=False)
    gone = column.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(gone, 0, np.diff(offsets))
    if gone.any() and (np.diff(offsets)[gone] > 0).any():
        values = values[np.repeat(~gone, np.diff(offsets))]
    return values, np.r_[0, np.cumsum(sizes)], gone


def lists(values: np.ndarray, sizes: np.ndarray, gone: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values).cast(kind), mask=pa.array(gone))


def ordered(mz: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in stable m/z order within each spectrum, which spectra weren't in order)."""
    place, n = np.arange(len(mz)), len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    down = (mz[1:] < mz[:-1]) & (row[1:] == row[:-1])
    bad = np.zeros(n, bool)
    bad[row[1:][down]] = True
    for k in np.flatnonzero(bad).tolist():
        lo, hi = offsets[k], offsets[k + 1]
        place[lo:hi] = lo + np.argsort(mz[lo:hi], kind="stable")
    return place, bad


def unmasked(intensity: np.ndarray, offsets: np.ndarray, masking: np.ndarray) -> np.ndarray:
    """Which points stay: all where masking is off, else every non-zero one and every zero beside one. A missing neighbour counts as zero."""
    some = intensity != 0
    before, after = np.r_[False, some[:-1]], np.r_[some[1:], False]
    starts, ends = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
    before[starts] = after[ends] = False
    return some | before | after | ~np.repeat(masking, np.diff(offsets))


def along(other: dict, n: int, order: np.ndarray) -> dict:
    """A further array with its values in an order of the n points; one of another length stays as it is. Whole numbers stay whole."""
    kinds = {"values": np.float64, "integers": np.int64}
    return other | {c: np.array(other[c], kind)[order] for c, kind in kinds.items() if other.get(c) is not None and len(other[c]) == n}


def piece(other: dict, n: int, begin: int, end: int, first: bool) -> dict | None:
    """A further array's values of the points [begin, end) of n; one of another length is whole in the first chunk and empty in the others."""
    out = dict(other)
    for c in ("values", "integers"):
        if (v := other.get(c)) is not None:
            out[c] = v[begin:end] if len(v) == n else v if first else []
    return out


def canonical(spectra: DataFrame, mask: bool, others: bool = False) -> DataFrame:
    """spectra with mz, intensity (doubles) and others in m/z order, profiles without interior zero runs, and was_unsorted.

    Arrays as long as m/z are permuted and masked along with it; arrays of another length stay as they are.
    """
    run = ordering(spectra.columns, mask, others)
    return spectra.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*spectra.dtypes, ("was_unsorted", "boolean")]))


def ordering(columns: list[str], mask: bool, others: bool):
    """What canonical does to batches of these columns."""
    names = [*columns, "was_unsorted"]
    at = {c: columns.index(c) for c in ("mz", "intensity", "representation")}
    more = columns.index("others") if others else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                cols = list(b.columns)
                mz, offsets, no_mz = flat(cols[at["mz"]])
                intensity, own, no_intensity = flat(cols[at["intensity"]])
                sizes = np.diff(offsets)
                place, bad = ordered(mz, offsets)
                profile = np.array([r == "profile" for r in cols[at["representation"]].to_pylist()], bool) & mask
                if (np.diff(own) == sizes).all():
                    intensity = intensity[place]
                    keep = unmasked(intensity, offsets, profile)
                    place, intensity = place[keep], intensity[keep]
                    sizes = np.add.reduceat(np.r_[keep, False].astype(np.int64), np.minimum(offsets[:-1], len(keep))) * (sizes > 0)
                    own_sizes = sizes
                else:  # some spectrum's axes differ in length: no masking there, and intensities stay as they are
                    out, keeps = [], []
                    for k in range(len(sizes)):
                        part, order = intensity[own[k] : own[k + 1]], place[offsets[k] : offsets[k + 1]] - offsets[k]
                        stays = np.ones(sizes[k], bool)
                        if len(part) == sizes[k]:
                            part = part[order]
                            stays = unmasked(part, np.array([0, len(part)]), profile[k : k + 1])
                            part = part[stays]
                        out.append(part)
                        keeps.append(stays)
                    intensity, own_sizes = np.concatenate(out), np.array([len(x) for x in out])
                    place, sizes = place[np.concatenate(keeps)], np.array([int(x.sum()) for x in keeps])
                cols[at["mz"]] = lists(mz[place], sizes, no_mz, pa.float64())
                cols[at["intensity"]] = lists(intensity, own_sizes, no_intensity, pa.float64())
                if others:
                    ends, moved = np.r_[0, np.cumsum(sizes)], []
                    for k, arrays in enumerate(cols[more].to_pylist()):
                        n, order = offsets[k + 1] - offsets[k], place[ends[k] : ends[k + 1]] - offsets[k]
                        moved.append(arrays and [along(a, n, order) for a in arrays])
                    cols[more] = pa.array(moved, b.schema.field(more).type)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(bad)], names=names)

    return run


#: Width of a stored chunk in m/z, and most points in one.
CHUNK_WIDTH, CHUNK_POINTS = 50.0, 1 << 14


def chunk_bounds(mz: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spectrum, begin, end) of the runs of points of one spectrum and one chunk, none longer than CHUNK_POINTS; a spectrum without points has one empty run."""
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(invalid="ignore"):
        chunk = np.floor(mz / CHUNK_WIDTH)
    begins = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (chunk[1:] != chunk[:-1])][: len(mz)])
    ends = np.r_[begins[1:], len(mz)][: len(begins)]
    parts = -(-(ends - begins) // CHUNK_POINTS)
    first = np.cumsum(parts) - parts
    begins = np.repeat(begins, parts) + (np.arange(parts.sum()) - np.repeat(first, parts)) * CHUNK_POINTS
    ends = np.minimum(np.repeat(ends, parts), begins + CHUNK_POINTS)
    empty = np.flatnonzero(sizes == 0)
    spectrum = np.r_[row[begins], empty]
    begins, ends = np.r_[begins, offsets[empty]], np.r_[ends, offsets[empty]]
    order = np.argsort(spectrum, kind="stable")
    return spectrum[order], begins[order], ends[order]


def bit_deltas(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Differences of the doubles' bit patterns as whole numbers, from run to run anew: nothing is rounded, and ascending values give small numbers."""
    bits = np.ascontiguousarray(values, np.float64).view(np.int64)
    out = bits.copy()
    with np.errstate(over="ignore"):
        out[1:] -= bits[:-1]
    out[begins] = bits[begins]
    return out


def from_bit_deltas(deltas: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The inverse, in runs by offsets: running sums that wrap around."""
    total = np.cumsum(deltas, dtype=np.int64)
    sizes = np.diff(offsets)
    with np.errstate(over="ignore"):
        before = np.repeat(np.r_[np.int64(0), total][offsets[:-1]], sizes)
        return (total - before).view(np.float64)


def off(source: np.ndarray, output: np.ndarray, tolerance: float) -> np.ndarray:
    """Which values differ by more than the tolerance relative to the source; values that aren't finite always do."""
    with np.errstate(invalid="ignore", over="ignore"):
        near = np.abs(output - source) <= tolerance * np.abs(source)
    return ~(np.isfinite(source) & np.isfinite(output) & near)


def positional(s: tuple[np.ndarray, np.ndarray], o: tuple[np.ndarray, np.ndarray], mz_tolerance: float, intensity_tolerance: float) -> tuple[int | None, int | None]:
    """First place at which m/z and intensities differ, None for nowhere; the shorter length where the lengths differ and all before agrees."""
    found = []
    for a, b, tolerance in ((s[0], o[0], mz_tolerance), (s[1], o[1], intensity_tolerance)):
        n = min(len(a), len(b))
        bad = np.flatnonzero(off(a[:n], b[:n], tolerance))
        found.append(int(bad[0]) if len(bad) else n if len(a) != len(b) else None)
    return found[0], found[1]


def merged(s: tuple[np.ndarray, np.ndarray], o: tuple[np.ndarray, np.ndarray], mz_tolerance: float, intensity_tolerance: float) -> dict[str, int | None]:
    """kept, dropped, dropped_nonzero, added and changed of a source spectrum against one with points left out, both in m/z order.

    mz_first and intensity_first are the places in the source of the first point that fails by either: one that isn't
    zero and was left out, or before which one was added; or whose intensity was changed. None if none does. An output point takes the first source point that is within the tolerance and comes after the one taken before.
    """
    (sm, si), (om, oi) = s, o
    n, m = len(sm), len(om)
    edge = sm + mz_tolerance * np.abs(sm)
    taken = np.searchsorted(edge, om, "left")
    taken = np.maximum.accumulate(taken - np.arange(m)) + np.arange(m) if m else taken
    fits = np.zeros(m, bool)
    inside = taken < n
    fits[inside] = ~off(sm[taken[inside]], om[inside], mz_tolerance)
    if not fits.all() or not (np.isfinite(sm).all() and np.isfinite(om).all()):
        return merged_slowly(s, o, mz_tolerance, intensity_tolerance)
    rest = np.ones(n, bool)
    rest[taken] = False
    lost, changed = np.flatnonzero(rest & (si != 0)), taken[off(si[taken], oi, intensity_tolerance)]
    first = lambda places: int(places[0]) if len(places) else None
    return {"kept": m, "dropped": n - m, "dropped_nonzero": len(lost), "added": 0, "changed": len(changed), "mz_first": first(lost), "intensity_first": first(changed)}


def merged_slowly(s, o, mz_tolerance: float, intensity_tolerance: float) -> dict[str, int | None]:
    """The same by two pointers, for the spectra that don't fit."""
    (sm, si), (om, oi) = s, o
    got: dict[str, int | None] = dict.fromkeys(("kept", "dropped", "dropped_nonzero", "added", "changed"), 0) | {"mz_first": None, "intensity_first": None}

    def fails(axis: str, place: int) -> None:
        got[axis] = place if got[axis] is None else got[axis]

    i = j = 0
    while i < len(sm) or j < len(om):
        if i < len(sm) and j < len(om) and not off(sm[i : i + 1], om[j : j + 1], mz_tolerance)[0]:
            got["kept"] += 1
            if off(si[i : i + 1], oi[j : j + 1], intensity_tolerance)[0]:
                got["changed"] += 1
                fails("intensity_first", i)
            i, j = i + 1, j + 1
        elif i < len(sm) and (j >= len(om) or sm[i] < om[j]):
            got["dropped"] += 1
            if si[i] != 0:
                got["dropped_nonzero"] += 1
                fails("mz_first", i)
            i += 1
        else:
            got["added"] += 1
            fails("mz_first", i)
            j += 1
    return got


def sorted_pair(mz: np.ndarray, intensity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(mz) > 1 and (mz[1:] < mz[:-1]).any():
        order = np.argsort(mz, kind="stable")
        return mz[order], intensity[order] if len(intensity) == len(mz) else intensity
    return mz, intensity


def compared(both: DataFrame, keys: list[str], mz_tolerance: float, intensity_tolerance: float) -> DataFrame:
    """(keys, mz_first, intensity_first, dropped_nonzero, tic_source, tic_output) of rows that have a pair's arrays as sm, si, om, oi and its representation.

    Profiles are merged, as the output leaves interior zeros out; others are compared place by place. Both sides are
    sorted first and source intensities narrowed as `single` says. A null array is an empty one. tic is summed in order.
    """
    names = [*keys, "mz_first", "intensity_first", "dropped_nonzero", "tic_source", "tic_output"]
    first = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                kinds, single = b.column(first).to_pylist(), b.column(first + 1).to_pylist()
                parts = [flat(b.column(first + 2 + k))[:2] for k in range(4)]
                rows = []
                for r, kind in enumerate(kinds):
                    sm, si, om, oi = (v[at[r] : at[r + 1]] for v, at in parts)
                    if single[r]:
                        with np.errstate(over="ignore"):
                            si = si.astype(np.float32).astype(np.float64)
                    s, o = sorted_pair(sm, si), sorted_pair(om, oi)
                    gone = 0
                    if len(sm) != len(si) or len(om) != len(oi):
                        mz_first, intensity_first = None, 0
                    elif kind == "profile":
                        got = merged(s, o, mz_tolerance, intensity_tolerance)
                        gone, mz_first, intensity_first = got["dropped_nonzero"], got["mz_first"], got["intensity_first"]
                    else:
                        mz_first, intensity_first = positional(s, o, mz_tolerance, intensity_tolerance)
                    rows.append((mz_first, intensity_first, gone, float(np.cumsum(s[1])[-1]) if len(s[1]) else 0.0, float(np.cumsum(o[1])[-1]) if len(o[1]) else 0.0))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                out = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:first], *out], names=names)

    rows = both.select(*keys, F.coalesce("representation", F.lit("unknown")).alias("representation"), F.coalesce("single", F.lit(False)).alias("single"), *[F.col(c).cast("array<double>").alias(c) for c in ("sm", "si", "om", "oi")])
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["mz_first long", "intensity_first long", "dropped_nonzero long", "tic_source double", "tic_output double"]))
