"""Sums over the entries of samples, for all samples of an Arrow batch at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def numbers(values: pa.Array, dtype: type = np.float64) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(dtype)


def vectors(lists: pa.Array, k: int) -> np.ndarray:
    return numbers(lists.flatten()).reshape(-1, k)


def starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def summed(cell: np.ndarray, v: np.ndarray, cells: int) -> np.ndarray:
    """Sums of the rows of v by cell."""
    return np.stack([np.bincount(cell, c, cells) for c in v.T], 1)


def by_key(feat: np.ndarray, field: np.ndarray | None, g: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    """feat[, field], g, q: a row for each key of the batch."""
    key, at = np.unique(feat if field is None else feat << 32 | field, return_inverse=True)
    columns = {"feat": pa.array(key if field is None else key >> 32, pa.int32())} | ({} if field is None else {"field": pa.array(key & 0xFFFFFFFF, pa.int32())})
    for name, v in (("g", g), ("q", q)):
        columns[name] = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1) * v.shape[1], pa.int32()), pa.array(summed(at, v, len(key)).ravel()))
    return pa.RecordBatch.from_pydict(columns)


@dataclass
class FieldRows:
    """The entries of an FFM's samples, a row for each entry and field of its sample.

    A sample of f fields has f * f cells: cell (i, j) is for the factors that entries of
    its field i have for its field j, and its mirror is (j, i).
    """

    fields: pa.Array
    entries: pa.Array
    k: int

    def __post_init__(self):
        self.nf, self.m = lengths(self.fields), lengths(self.entries)
        n, each = len(self.nf), self.entries.flatten()
        self.of = np.repeat(np.arange(n), self.m)
        self.feat, field = numbers(each.field("feat"), np.int64), numbers(each.field("field"), np.int64)
        self.value, self.vx = numbers(each.field("value")), vectors(each.field("vx").flatten(), self.k)
        width = self.nf[self.of]
        self.entry = np.repeat(np.arange(len(width)), width)
        self.sample = self.of[self.entry]
        self.j = np.arange(len(self.entry)) - starts(width)[self.entry]
        self.place = starts(self.nf)[self.sample] + self.j  # of the row's field among all fields
        self.field = numbers(self.fields.flatten(), np.int64)[self.place]
        self.own = self.field == field[self.entry]
        self.i = self.j[self.own]
        first = starts(self.nf**2)[self.sample]
        self.cell = first + self.i[self.entry] * self.nf[self.sample] + self.j
        self.mirror = first + self.j * self.nf[self.sample] + self.i[self.entry]
        self.cells = int((self.nf**2).sum())
        self.sums = summed(self.cell, self.vx, self.cells)

    def crossed(self) -> np.ndarray:
        """The sum over pairs of entries of each sample: half of what fields have with each other, less what entries have with themselves."""
        n, square = len(self.nf), self.nf**2
        sample = np.repeat(np.arange(n), square)
        i, j = np.divmod(np.arange(self.cells) - starts(square)[sample], np.maximum(self.nf[sample], 1))
        mirror = starts(square)[sample] + j * self.nf[sample] + i
        every = np.bincount(sample, (self.sums * self.sums[mirror]).sum(1), n)
        alone = np.bincount(self.of, (self.vx[self.own] ** 2).sum(1), n)
        return np.where(self.m > 0, 0.5 * (every - alone), 0.0)

    def gradients(self, e: np.ndarray) -> pa.RecordBatch:
        """feat, field, g, q. What an entry's factors for a field get is the sum of that field's other entries for its own field; a field that no other entry of the sample has gives no row."""
        squares, own = self.vx**2, self.own[:, None]
        scale = (e[self.sample] * self.value[self.entry])[:, None]
        g = scale * (self.sums[self.mirror] - np.where(own, self.vx, 0))
        q = scale * scale * np.maximum(summed(self.cell, squares, self.cells)[self.mirror] - np.where(own, squares, 0), 0)
        others = np.bincount(self.place[self.own], minlength=int(self.nf.sum()))[self.place] - self.own > 0
        return by_key(self.feat[self.entry][others], self.field[others], g[others], q[others])


def fm_gradient(e: np.ndarray, s: pa.Array, entries: pa.Array, k: int) -> pa.RecordBatch:
    """feat, g, q. s: sums of v * value of each sample; entries: feat, value, v."""
    each, of = entries.flatten(), np.repeat(np.arange(len(e)), lengths(entries))
    x, v = numbers(each.field("value"))[:, None], vectors(each.field("v"), k)
    g = e[of][:, None] * (x * vectors(s, k)[of] - v * x * x)
    return by_key(numbers(each.field("feat"), np.int64), None, g, g * g)
