"""Substring dedup: seeds from winnowing, extended to both sides to maximal repeats.

Every window of WINDOW words holds one anchor: its ANCHOR-word sequence of the
smallest hash (the first of equal ones). Neighbouring windows mostly share theirs; a
stretch of windows with one anchor is a run, an anchor with the words around it that a
match through it can take up. Equal windows have equal anchors at equal offsets, so
documents are joined on anchors, and matches are extended from there for all
occurrences of an anchor at once, as one by one would take all pairs of a hot anchor:

* to the whole run: occurrences whose stretches of words are equal match over all of
  it, to both sides, and go on in the runs beside it;
* where stretches differ, a match ends within the run: the words from k before the
  anchor to WINDOW - ANCHOR - k after it are compared by hash for each k, so that of
  all ways to extend a match to the least length none is missed.

Extended matches that touch are one: their union is the set of maximal repeats of at
least WINDOW words, which come out as spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.llm.common import bit_filter, materialize, own_exchange, read_table, small_batches, texts
from sparseloom.llm.words import WordHashes, mixed

WINDOW, ANCHOR = 35, 8
#: Odd base of the running hashes of word sequences.
_BASE = 0xD1342543DE82EF95
#: Runs of a document are told by their first window and how many windows follow it (below 2**_TAIL).
_TAIL = 6

_hashes = WordHashes()


class Runs:
    """Runs of a batch of texts: document number, first window (from the document's start), number of further windows, hashes of anchor and stretch."""

    def __init__(self, texts_: list[str], window: int):
        words = [_hashes.of(t.encode("utf-8").split()) for t in texts_]
        n = np.fromiter(map(len, words), np.int64, len(words))
        self.window, ends = window, np.cumsum(n)
        w = np.concatenate([*words, np.zeros(0, np.uint64)])
        doc = np.repeat(np.arange(len(n)), n)
        start = np.flatnonzero(np.arange(len(w)) + window <= ends[doc])
        power = np.full(len(w) + 1, _BASE, np.uint64)
        power[0] = 1
        inverse = np.full(len(w) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        power, self.inverse = np.cumprod(power), np.cumprod(inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * power[:-1])])
        if not len(start):
            self.doc = self.at = self.first = np.zeros(0, np.int64)
            self.anchor = self.stretch = np.zeros(0, np.uint64)
            return
        gram = mixed(self._hash(np.arange(len(w) - ANCHOR + 1), ANCHOR))
        place = self._first_least(gram, window - ANCHOR + 1)[start]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (np.diff(place) != 0)]))
        first, more = start[new], np.diff(np.append(new, len(start))) - 1
        self.doc, self.first = doc[first], first
        self.more = more
        self.at = ((first - (ends - n)[self.doc]) << _TAIL) | more
        self.anchor = mixed(gram[place[new]] + np.uint64(1))
        self.stretch = mixed(self._hash(first, more + window) + more.astype(np.uint64))

    def _hash(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    @staticmethod
    def _first_least(v: np.ndarray, width: int) -> np.ndarray:
        """For each start, the place of the first of the smallest among width values; by doubling."""
        at, have = np.arange(len(v)), 1
        while have < width:
            step = min(have, width - have)
            less = v[step:] < v[:-step]
            at, v = np.where(less, at[step:], at[:-step]), np.where(less, v[step:], v[:-step])
            have += step
        return at

    def windows(self, run: int) -> np.ndarray:
        """Hashes of the windows of a run."""
        start = self.first[run] + np.arange(self.more[run] + 1)
        return mixed(self._hash(start, self.window))


def _scan(base: DataFrame, window: int, rows: Callable[[Runs, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows(Runs(b.column(2).to_pylist(), window), b)

    return small_batches(base.select("id", "version", "text")).mapInArrow(run, schema)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and text with the key of a row: id (a null one as the smallest number) and version, a hash of id and text."""
    base = texts(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    return base.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("doc_id", "text").alias("version"), "text")


def find_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeated windows: id, version, first (window of a run), mask (bit k: the window first + k occurs elsewhere too)."""
    base = _keyed(docs, id_col, text_col)

    def occurrences(r: Runs, b: pa.RecordBatch) -> pa.RecordBatch:
        row = pa.array(r.doc)
        return pa.RecordBatch.from_arrays([signed(r.anchor), signed(r.stretch), b.column(0).take(row), b.column(1).take(row), pa.array(r.at)], ["anchor", "stretch", "id", "version", "at"])

    signed = lambda x: pa.array(x.view(np.int64))
    seen = materialize(_scan(base, window, occurrences, "anchor long, stretch long, id long, version long, at long"), "runs")
    # a class: runs of one anchor with equal words; its number of runs and the place of one of them, as a hash
    place = F.col("version").bitwiseXOR(F.shiftleft("at", 36))
    classes = materialize(seen.groupBy("anchor", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one")), "classes")
    whole = seen.join(classes.filter("n > 1").select("anchor", "stretch"), ["anchor", "stretch"])
    whole = whole.select("id", "version", F.shiftright("at", _TAIL).alias("first"), F.expr(f"shiftleft(1L, cast(at & {(1 << _TAIL) - 1} AS int) + 1) - 1").alias("mask"))
    # runs that occur once, and one run of each class that they may share windows with
    unclear = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).filter("k > 1 AND least = 1").select("anchor")
    tests = materialize(classes.join(unclear, "anchor").select("anchor", "n", "one"), "tests")
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(tests, "one"))

    def windows(r: Runs, b: pa.RecordBatch) -> pa.RecordBatch:
        one = b.column(1).to_numpy()[r.doc] ^ (r.at << 36)
        use = np.flatnonzero(wanted.value.passes(one.view(np.uint64)))
        row = pa.array(r.doc[use])
        hashes = [r.windows(i).view(np.int64) for i in use]
        ends = pa.array(np.cumsum([0, *map(len, hashes)]), pa.int32())
        flat = pa.array(np.concatenate([*hashes, np.zeros(0, np.int64)]))
        return pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(r.at[use]), pa.array(one[use]), pa.ListArray.from_arrays(ends, flat)], ["id", "version", "at", "one", "windows"])

    # a run of a row that is there twice comes twice, but is of a class of more than one run then, whose windows are only looked up
    hashed = _scan(base, window, windows, "id long, version long, at long, one long, windows array<long>")
    tested = materialize(hashed.join(tests, "one").drop("one"), "windows")
    each = tested.select("anchor", "n", "id", "version", F.shiftright("at", _TAIL).alias("first"), F.posexplode("windows").alias("k", "hash"))
    again = each.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("anchor", "hash")
    ends = each.filter("n = 1").join(own_exchange(again, "anchor", "hash"), ["anchor", "hash"]).groupBy("id", "version", "first").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
    return whole.union(ends.select("id", "version", "first", "mask"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop every word that lies in a window of words which starts anywhere else too.

    Returns a row for each input row: doc_id, text (the words that stay, joined by one
    space), n_words, n_removed, repeats (start and end word of each maximal repeat).

    Words are runs of characters other than ASCII white space, unchanged. Windows are
    judged on the input: all copies of a passage go, the first one too. Null and empty
    texts, and texts shorter than a window, lose nothing. Equal rows are documents of
    their own, so each repeats the other. A row without an id is treated like others.
    An empty table gives an empty result; columns besides id and text are not read.

    Texts are scanned twice but shuffled once. Runs are counted with sums before the
    shuffle; a filter of bounded size keeps most runs that need no further look out of
    the second scan's output; a hot anchor is a key that joins can split, and no list of
    its occurrences is gathered anywhere.
    """
    marks = materialize(find_repeats(docs, window, id_col, text_col), "marks")
    marks = marks.distinct().groupBy("id", "version").agg(F.collect_list(F.struct("first", "mask")).alias("marks"))
    joined = _keyed(docs, id_col, text_col).join(marks, ["id", "version"], "left").select("doc_id", "text", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n_words, n_removed, repeats = [], [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = text.split(None) if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else [w.decode("utf-8") for w in text.encode("utf-8").split()]
                gone = np.zeros(len(words) + 1, np.int64)
                for m in found or ():
                    for k in range(m["mask"].bit_length()):
                        if m["mask"] >> k & 1:
                            gone[m["first"] + k] += 1
                            gone[m["first"] + k + window] -= 1
                covered = np.cumsum(gone)[: len(words)] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))).tolist()
                repeats.append([{"start": i, "end": j} for i, j in zip(edge[::2], edge[1::2])])
                n_words.append(len(words)), n_removed.append(int(covered.sum()))
                out.append(" ".join([w for w, c in zip(words, covered.tolist()) if not c] if edge else words))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(out, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(repeats, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ], ["doc_id", "text", "n_words", "n_removed", "repeats"])

    return small_batches(joined).mapInArrow(cut, "doc_id long, text string, n_words long, n_removed long, repeats array<struct<start: long, end: long>>")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
g AS (SELECT rid, i, string_agg(x, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS s, n FROM u),
h AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS k FROM g WHERE i + 34 <= n) WHERE k >= 2),
v AS (SELECT rid, x, i, max(h_i) OVER (PARTITION BY rid ORDER BY i) AS last
      FROM (SELECT u.rid, u.x, u.i, h.i AS h_i FROM u LEFT JOIN h ON u.rid = h.rid AND u.i = h.i)),
k AS (SELECT rid, count(*) FILTER (WHERE last > i - 35) AS n_removed,
             string_agg(x, ' ' ORDER BY i) FILTER (WHERE last IS NULL OR last <= i - 35) AS kept
      FROM v GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (rid)
"""

QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLES = {"op4_substring_dedup": SQL}
