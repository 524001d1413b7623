"""Byte-level BPE encoding and decoding by merges in padded numpy matrices."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.llm.common import read_table, small_batches, texts
from sparseloom.llm.pieces import Encoder

NONE = np.int32(2**31 - 1)
#: Widths of the matrices, in bytes of a piece, and on by doubling; cells of a matrix, a wider row apart.
WIDTHS = (4, 8, 12, 16, 24, 32, 48)
ROWS, CELLS = 4096, 1 << 20


class Ranks:
    """A rank file: token bytes by id, and a hash table from pairs of ids to the id that joins them."""

    def __init__(self, data: bytes):
        rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.rank = rank
        self.token = [b""] * (max(rank.values()) + 1)
        for token, i in rank.items():
            self.token[i] = token
        self.byte = np.full(256, -1, np.int32)
        for b in range(256):
            self.byte[b] = rank[bytes([b])]
        left, right, joined = [], [], []
        for token, i in rank.items():
            for k in range(1, len(token)):
                a, b = rank.get(token[:k]), rank.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), joined.append(i)
        self._fill(np.array(left, np.int64), np.array(right, np.int64), np.array(joined, np.int32))
        # ids that can be part of an older token: joining all their occurrences at once could skip a merge
        self.unsafe = np.zeros(len(self.token), bool)
        for part in (np.array(left), np.array(right)):
            self.unsafe[part[np.array(joined) < part]] = True

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray) -> None:
        """Open addressing: a key that finds its slot taken tries the next one."""
        self.bits = int(np.ceil(np.log2(4 * len(left) + 2)))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        key, value = (left << 32) | right, joined
        slot, self.probes = self._slot(key), 0
        while len(key):
            self.probes += 1
            free = self.keys[slot] < 0
            place, one = np.unique(slot[free], return_index=True)
            one = np.flatnonzero(free)[one]
            self.keys[place], self.values[place] = key[one], value[one]
            rest = np.ones(len(key), bool)
            rest[one] = False
            key, value, slot = key[rest], value[rest], (slot[rest] + 1) & (size - 1)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that joins each pair, or NONE; an id below 0 is padding."""
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        key[(a < 0) | (b < 0)] = -2
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        left = np.flatnonzero((found != key) & (found >= 0) & (key >= 0))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[left]]
            hit = found == key[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def merge_rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Every row joins its leftmost pair of the smallest rank in each round, until no row has a pair left.

        The next pairs of that rank to the right are the next leftmost ones, so they are
        joined in the same round, unless the new id could begin or end a pair of a still
        smaller rank.
        """
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        width = int(lengths.max())
        columns = np.arange(width + 1)
        ids = np.full((n, width + 1), -1, np.int32)
        ids[columns < lengths[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        row = np.arange(n)
        pair = self.join(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        while len(row):
            c = pair.argmin(1)  # the first of equal ones
            r = np.arange(len(row))
            best = pair[r, c]
            more = best != NONE
            if not more.all():
                for i in np.flatnonzero(~more):
                    out[row[i]] = ids[i, : lengths[i]].copy()
                ids, pair, row, best, lengths, c = ids[more], pair[more], row[more], best[more], lengths[more], c[more]
                if not len(row):
                    break
                r = np.arange(len(row))
            if width > WIDTHS[-1]:  # short rows seldom have a second pair of the rank
                r, c = self._leftmost(pair, best, c)
            ids[r, c] = best[r]
            # compaction: the second id of each pair goes, what follows moves to the left
            if len(r) == len(row):
                at, take = c, np.minimum(columns + (columns > c[:, None]), width)
                lengths = lengths - 1
            else:
                gone = np.zeros(ids.shape, np.uint8)
                gone[r, c + 1] = 1
                take = np.argsort(gone, 1, kind="stable")
                at = c - (np.arange(len(r)) - np.searchsorted(r, r))
                lengths = lengths - np.bincount(r, minlength=len(row))
            ids = np.take_along_axis(ids, take, 1)
            pair = np.take_along_axis(pair, np.minimum(take[:, :width], width - 1), 1)
            if len(r) == len(row):
                ids[:, width], pair[:, width - 1] = -1, NONE
            else:
                ids[columns >= lengths[:, None]] = -1
                pair[columns[:width] >= lengths[:, None] - 1] = NONE
            pair[r, at] = self.join(ids[r, at], ids[r, at + 1])
            left = at > 0
            r, at = r[left], at[left]
            pair[r, at - 1] = self.join(ids[r, at - 1], ids[r, at])
            longest = int(lengths.max())
            if longest <= width // 2:
                width, columns = longest, columns[: longest + 1]
                ids, pair = ids[:, : width + 1].copy(), pair[:, :width].copy()
        return out

    def _leftmost(self, pair: np.ndarray, best: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the first pair of the best rank, and of the next ones of that rank that can be joined in the same round."""
        hit = pair == best[:, None]
        alone = np.flatnonzero(self.unsafe[best])
        hit[alone] = False
        hit[alone, first[alone]] = True
        if (hit[:, 1:] & hit[:, :-1]).any():  # of overlapping pairs every second one, from the left
            columns = np.arange(pair.shape[1])
            before = np.maximum.accumulate(np.where(hit, -1, columns), 1)
            hit &= (columns - before) % 2 == 1
        return np.nonzero(hit)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.rank.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif p:
                by_width.setdefault(next((w for w in WIDTHS if len(p) <= w), 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, which in by_width.items():
            rows = max(1, min(ROWS, CELLS // width))
            for k in range(0, len(which), rows):
                part = which[k : k + rows]
                for i, ids in zip(part, self.merge_rows([pieces[i] for i in part])):
                    out[i] = ids.astype("<u4").tobytes()
        return out

    def decode(self, ids: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


class Bpe(Encoder):
    def __init__(self, data: bytes, pattern: str):
        self.ranks = Ranks(data)
        self.pattern = regex.compile(pattern)
        super().__init__(self._pieces)

    def _pieces(self, pieces: list[str], after_space: bool) -> list[bytes]:
        """Ids of pieces from the ids of their matches; a match that several pieces have is merged once."""
        matches = [self.pattern.findall(f" {p}" if after_space else p) for p in pieces]
        new = list(dict.fromkeys(m for found in matches for m in found))
        ids = dict(zip(new, self.ranks.encode([m.encode("utf-8") for m in new])))
        return [b"".join([ids[m] for m in found]) for found in matches]


_workers: dict[tuple[str, str], Bpe] = {}


def _bpe(data: bytes, pattern: str) -> Bpe:
    """The tables of this Python worker, built once."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _workers:
        _workers[key] = Bpe(data, pattern)
    return _workers[key]


def _ranks_of(spark: SparkSession, path: str):
    with open(path, "rb") as f:  # a vocabulary file of under 1 MB, read by the driver and sent to the tasks
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of whole texts: doc_id, ids (array of int), a row for each input row.

    Each match of pattern is merged by itself and by rank; a match that is a token is
    taken whole. A null or empty text gives an empty array. Equal rows give equal
    results and a row without an id is encoded like others. No shuffle: memory holds
    one Arrow batch and a bounded table of pieces. Columns besides id and text are not read.
    """
    sent = _ranks_of(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(sent.value, pattern)
        for b in batches:
            ids = [np.frombuffer(x, "<i4") for x in bpe.batch(b.column(1).to_pylist())]
            ends = np.cumsum([0, *map(len, ids)])
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "ids"])

    base = texts(docs, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    return small_batches(base).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of token ids: doc_id, data (binary). Null ids count as none; an id that the file lacks is an error."""
    sent = _ranks_of(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _bpe(sent.value, public_tokenizers.PATTERN).ranks
        for b in batches:
            column = b.column(1)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist())])
            data = [ranks.decode(flat[i:j].astype("<u4").tobytes()) for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    base = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return small_batches(base).mapInArrow(run, f"doc_id {kind}, data binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and sum up in one pass: doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_sha256, n_bytes.

    The cases of nulls, empty texts and repeated rows are those of encode.
    """
    sent = _ranks_of(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(sent.value, pattern)
        for b in batches:
            ids = bpe.batch(b.column(1).to_pylist())
            data = [bpe.ranks.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string()),
                pa.array([len(x) for x in data], pa.int64()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    base = texts(docs, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    return small_batches(base).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLES: dict[str, str] = {}
