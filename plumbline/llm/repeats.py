"""Exact search for windows of ``width`` units (words or bytes) that occur more than once, by anchors.

Every window has one anchor, chosen by what the window holds: equal windows have equal anchors at equal places. Neighbouring windows
share an anchor; such a run of windows is a context. Only contexts travel, as hashes:

- equal contexts hold equal windows, so a context that occurs again needs no closer look;
- contexts with the same anchor key but different content may share some windows: of those, one occurrence each is read again, and its
  windows are compared by hash (64 bits of the window under 64 bits of the key).

Common passages and groups of copies thus cost one aggregated row per context, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from plumbline.llm.common import Powers, mix, pieces, utf8

PLACE_BITS = 28  # units in one piece: one text has fewer than 2 ** 28
_POWERS = Powers(0xC2B2AE3D27D4EB4F)


class Hashes:
    """Hashes of any stretch of units from prefix sums."""

    def __init__(self, h: np.ndarray):
        up, self.down = _POWERS.to(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start] + np.uint64(length) if np.isscalar(length)
                   else (self.sums[start + length] - self.sums[start]) * self.down[start] + length.astype(np.uint64))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(v) - width + 1
    if n <= 0:
        return v[:0]
    full = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(v)] = v
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


@dataclass
class Contexts:
    doc: np.ndarray  # index of the text
    start: np.ndarray  # first window, counted in the text
    count: np.ndarray  # windows
    key: np.ndarray  # hash around the anchor
    content: np.ndarray  # hash of all units that the windows cover
    anchor: np.ndarray  # place of the anchor in the piece


def contexts(h: np.ndarray, first: np.ndarray, rank: np.ndarray, width: int, low: int, span: int, key_from: int, key_units: int) -> Contexts:
    """Contexts of all texts of a piece.

    The anchor of the window at ``s`` is the place of least ``rank`` among s + low .. s + low + span - 1, the leftmost of equal ones; its
    key is the hash of ``key_units`` units from ``key_from`` units off the anchor, which lie inside the window.
    """
    size = np.diff(first)
    windows = np.maximum(0, size - width + 1)
    total = int(windows.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return Contexts(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    doc = np.repeat(np.arange(len(size)), windows)
    at = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)  # in the text
    s = first[:-1][doc] + at
    place = np.arange(len(rank), dtype=np.uint64)
    least = sliding_min((rank >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place, span)
    anchor = (least[s + low] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    edge = np.flatnonzero(new)
    count = np.diff(np.r_[edge, total])
    hashes = Hashes(h)
    begin, anchor = s[edge], anchor[edge]
    return Contexts(doc[edge], at[edge], count, hashes.of(anchor + key_from, key_units), hashes.of(begin, count + width - 1), anchor)


def windows_of(units, text: str, width: int, carry: list[str]):
    """For rows with a text and ``asked`` (array of key, content, start, count): a row for every window with its hash and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                col = lambda c: batch.column(batch.schema.get_field_index(c))
                h, first = units(*utf8(col(text))[:2])
                asked = col("asked")
                row = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())
                flat = asked.flatten()
                field = lambda c: flat.field(c).to_numpy(zero_copy_only=False)
                start, count = field("start").astype(np.int64), field("count").astype(np.int64)
                one = np.repeat(np.arange(len(row)), count)
                place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                hashes = Hashes(h).of(first[:-1][row][one] + start[one] + place, width)
                out = {"key": pa.array(field("key")[one]), "content": pa.array(field("content")[one]), "place": pa.array(place.astype(np.int32)), "window": pa.array(hashes.view(np.int64))}
                for c in carry:
                    out[c] = col(c).take(pa.array(row[one]))
                yield pa.RecordBatch.from_pydict(out)

    return run


def covered(size: int, spans: list[dict], width: int) -> np.ndarray:
    """Marks of units inside any window that starts in a span (``start``, ``count``)."""
    step = np.zeros(size + 1, np.int64)
    for x in spans:
        step[x["start"]] += 1
        step[min(size, x["start"] + x["count"] + width - 1)] -= 1
    return np.cumsum(step[:-1]) > 0
