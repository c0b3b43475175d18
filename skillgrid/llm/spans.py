"""Numpy helpers over Arrow text batches: words, rolling hashes, content-chosen anchors, covered runs.

Everything here works on one bounded piece of text inside a Spark task; no
function looks at more than the arrays it is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
LANE = [np.uint64((1 << (8 * k)) - 1) for k in range(8)] + [np.uint64(0xFFFFFFFFFFFFFFFF)]
_LANE_MASK = np.array(LANE, dtype=np.uint64)
_BYTE_HASH = np.random.default_rng(7).integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (multiply and shift, one to one)."""
    x = x ^ (x >> np.uint64(32))
    x *= C3
    x ^= x >> np.uint64(29)
    x *= C2
    x ^= x >> np.uint64(32)
    return x


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring runs from the hashes of both; order counts."""
    x = left * C1
    x += right
    x ^= x >> np.uint64(31)
    x *= C3
    x ^= x >> np.uint64(30)
    return x


def rolling(h: np.ndarray, k: int, upto: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Hash of every run of ``k`` neighbours of ``h`` (length len(h) - k + 1), by doubling."""
    if len(h) < k:
        return h[:0]
    out, taken, power, size = None, 0, h, 1
    while True:
        if k & size:
            out = power if out is None else combine(power[: len(h) - taken - size + 1], out[size:][: len(h) - taken - size + 1])
            taken += size
        if taken == k:
            return out[: len(h) - k + 1]
        power = combine(power[:-size], power[size:])
        size *= 2


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours."""
    size = 1
    while size * 2 <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (w - size)], v[w - size:]) if w > size else v


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and each row's offsets (n + 1); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0]: offsets[-1]] if len(offsets) else raw[:0]
    return raw, offsets - (offsets[0] if len(offsets) else 0)


def is_space(raw: np.ndarray) -> np.ndarray:
    """ASCII white space: x20 and x09 to x0D."""
    return (raw == 32) | ((raw - np.uint8(9)) <= 4)


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    inside = np.zeros(len(raw) + 1, dtype=bool)
    np.logical_not(is_space(raw), out=inside[:-1])
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    last = inside[:-1] & ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) * C1 + np.uint64(seed))
    live, at = np.arange(len(starts)), starts
    while len(live):
        size = left[live]
        part = lanes[at] & _LANE_MASK[np.minimum(size, 8)]
        h[live] = mix((h[live] * C1) ^ part)
        more = size > 8
        live, at = live[more], at[more] + 8
        left[live] -= 8
    return h


def byte_hashes(raw: np.ndarray) -> np.ndarray:
    return _BYTE_HASH[raw]


def anchored_runs(h: np.ndarray, row: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Cut the windows of ``width`` elements into runs that share their anchor.

    A window's anchor is its least gram of ``gram`` elements (by the upper hash
    half, the first of equals), so equal windows have equal anchors wherever
    they stand.  Returns per run: ``anchor`` (64-bit hash of the gram), ``digest``
    (64-bit hash over all its windows), ``row``, ``start`` (element index of the
    first window), ``n`` (windows) and ``off`` (elements from start to the gram).
    """
    n = len(h) - width + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return dict(anchor=h[:0], digest=h[:0], row=e, start=e, n=e, off=e)
    g = rolling(h, gram)
    at = np.arange(len(g), dtype=np.uint64)
    best = sliding_min((g & np.uint64(0xFFFFFFFF00000000)) | at, width - gram + 1)
    where = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = row[:n] == row[width - 1:]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(where[1:], where[:-1], out=new[1:])
    new[1:] |= row[1:n] != row[: n - 1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    good = whole[start]
    # windows of one row that reach into the next stand at its end: cut them off
    lost = np.concatenate([[0], np.cumsum(~whole)])
    end = end - (lost[end] - lost[start])
    start, end = start[good], end[good]
    w = mix(rolling(h, width))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w, dtype=np.uint64)])
    digest = mix(total[end] - total[start] + (end - start).astype(np.uint64))
    return dict(anchor=g[where[start]], digest=digest, row=row[start], start=start, n=end - start, off=where[start] - start)


def anchor_table(h: np.ndarray, row: np.ndarray, width: int, gram: int, step: int = 32_768) -> dict[str, np.ndarray]:
    """``anchored_runs`` over any length, ``step`` windows at a time; repeats of a run right behind itself fold into ``reps``.

    A step's arrays stay in the processor's cache.  A run cut at a step's edge
    counts as two shorter runs of the same anchor.
    """
    parts = []
    for at in range(0, max(1, len(h) - width + 1), step):
        part = anchored_runs(h[at:at + step + width - 1], row[at:at + step + width - 1], width, gram)
        part["start"] = part["start"] + at
        parts.append(part)
    t = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    if len(t["n"]):
        again = np.zeros(len(t["n"]), bool)
        again[1:] = np.logical_and.reduce([t[k][1:] == t[k][:-1] for k in ("anchor", "digest", "row", "n", "off")])
        again[1:] &= t["start"][1:] - t["start"][:-1] == t["n"][:-1]
        first = np.flatnonzero(~again)
        t = {k: v[first] for k, v in t.items()} | {"reps": np.diff(np.append(first, len(again)))}
    else:
        t["reps"] = t["n"]
    return t


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` elements lie inside any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of True."""
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
