"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed (SEED words in a row) are tiled:
the longest common sequence of words not yet covered is marked, again and again,
down to the seed length. Covered words over words of the item is the coverage;
passages whose parts were put in another order are covered like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.llm.common import bit_filter, materialize, read_table, sliced, small_batches, texts
from sparseloom.llm.words import WordHashes, gram_hashes

#: Words of a seed, and of the shortest tile.
SEED = 5
#: Share of an item's words that must be covered.
COVERAGE = 0.6
#: The filter for seeds has 2**25 to 2**28 bits (4 to 32 MB), however large the benchmark is. Few false hits pay: each costs a row beyond the scan.
LEAST_BITS, FILTER_BITS = 25, 28
_EDGE = b".,;:!?\"'()[]{}<>*#&%$|-_"
#: Base of the running hashes.
_BASE = 1_000_003


def _normal(word: bytes) -> bytes:
    return word.lower().strip(_EDGE) or word


_hashes = WordHashes(_normal)


def words_of(text: str) -> np.ndarray:
    """Words as hashes; letter case and punctuation around a word don't count."""
    return _hashes.of(text.encode("utf-8").split())


def seeds_of(words: np.ndarray, seed: int) -> np.ndarray:
    """A hash for each seed. A sequence that is shorter than a seed is one itself."""
    return gram_hashes(words, min(seed, len(words))) if len(words) else np.zeros(0, np.uint64)


def tiles(item: np.ndarray, segments: list[np.ndarray], least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in the joined segments, length), longest first.

    Among equally long matches the one earlier in the item, then earlier in the
    document, is marked first.
    """
    least = max(1, min(least, len(item)))
    text = np.concatenate(segments) if segments else np.zeros(0, np.uint64)
    ends = np.cumsum([len(s) for s in segments])
    # a word that is marked, or that ends a segment, lies in no window across it
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    room_text = np.zeros(len(text), np.int64)
    found: list[tuple[int, int, int]] = []

    def room(free: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Free words from each place to the next marked one or stop."""
        stop = np.concatenate([np.flatnonzero(~free), stops])
        stop.sort()
        at = np.arange(len(free))
        return np.where(free, stop[np.searchsorted(stop, at + free)] - at, 0)

    def matches(n: int, once: bool) -> list[tuple[int, int]]:
        a = np.flatnonzero(room_item >= n)
        b = np.flatnonzero(room_text >= n)
        if not len(a) or not len(b):
            return []
        ha, hb = _window_hashes(item, n)[a], _window_hashes(text, n)[b]
        common = np.intersect1d(ha, hb)
        if not len(common):
            return []
        a, ha, b, hb = a[np.isin(ha, common)], ha[np.isin(ha, common)], b[np.isin(hb, common)], hb[np.isin(hb, common)]
        out = []
        for i, h in zip(a, ha):
            for j in b[hb == h]:
                if np.array_equal(item[i : i + n], text[j : j + n]):
                    out.append((int(i), int(j)))
                    if once:
                        return out
        return out

    longest = min(len(item), int(max((len(s) for s in segments), default=0)))
    while longest >= least:
        room_item, room_text = room(free_item, np.array([len(item)])), room(free_text, ends)
        low, high = least - 1, longest  # a match of n words holds one of n - 1
        while low < high:
            n = (low + high + 1) // 2
            if matches(n, True):
                low = n
            else:
                high = n - 1
        if low < least:
            break
        for i, j in matches(low, False):
            if free_item[i : i + low].all() and free_text[j : j + low].all():
                free_item[i : i + low] = free_text[j : j + low] = False
                found.append((i, j, low))
        longest = low
    return found


def _window_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all windows of n words: running sums over powers, scaled to a common start."""
    power = np.full(len(x) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    inverse = np.full(len(x) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[:-1])])
    m = len(x) - n + 1
    return (run[n:] - run[:m]) * inverse[:m] if m > 0 else np.zeros(0, np.uint64)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, words and item_version (a hash of these) of items that have a word. Items of one id and equal words are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([words_of(t).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["item_id", "item"])

    base = benchmark.select(benchmark[id_col].alias("item_id"), F.coalesce(benchmark[text_col], F.lit("")).alias("text")).filter(F.col("item_id").isNotNull())
    kind = base.schema["item_id"].dataType.simpleString()
    found = small_batches(base).mapInArrow(run, f"item_id {kind}, item array<long>").filter(F.size("item") > 0).distinct()
    return found.withColumn("item_version", F.xxhash64("item"))


def _item_seeds(items: DataFrame, seed: int) -> DataFrame:
    """seed, item_id, item_version and n_item: a row for each distinct seed of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, words in enumerate(b.column(1).to_pylist()):
                s = np.unique(seeds_of(np.array(words, np.int64).view(np.uint64), seed))
                of = pa.array(np.full(len(s), k))
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), b.column(0).take(of), b.column(2).take(of), pa.array(np.full(len(s), len(words), np.int32))], ["seed", "item_id", "item_version", "n_item"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(run, f"seed long, item_id {kind}, item_version long, n_item int")


def cover(words: int, at: np.ndarray, n: int) -> int:
    """Words that lie in windows of n words starting at these places."""
    edge = np.zeros(words + 1, np.int64)
    edge[at] += 1
    edge[at + n] -= 1
    return int((np.cumsum(edge) > 0).sum())


def telling_seeds(item: np.ndarray, heat: dict[int, int], seed: int, coverage: float) -> np.ndarray:
    """The seeds of which every document that covers enough of the item holds one; the hottest ones are spared.

    heat has the pairs that a seed would make; one that no document holds is left out.
    Tiles lie within windows of shared seeds. The hottest seeds whose windows together
    cover too few words can't make a leak by themselves, so one of the others is there.
    """
    found = seeds_of(item, seed).view(np.int64)
    n = min(seed, len(item))
    hot = sorted((s for s in set(found.tolist()) if s in heat), key=lambda s: (-heat[s], s))
    low, high = 0, len(hot)  # the longest run of hottest seeds that is spared
    while low < high:
        k = (low + high + 1) // 2
        if cover(len(item), np.flatnonzero(np.isin(found, hot[:k])), n) / len(item) < coverage:
            low = k
        else:
            high = k - 1
    return np.array(hot[low:], np.int64)


def held_words(item: np.ndarray, n: int, found: np.ndarray, places: list[list[int]]) -> list[np.ndarray]:
    """The words that a document has where it holds seeds (of n words) of the item, in stretches that don't touch: the item knows them, so places suffice. Seeds of equal hashes are taken for equal."""
    each, first = np.unique(gram_hashes(item, n).view(np.int64), return_index=True)
    at = np.concatenate([np.array(p, np.int64) for p in places])
    source = first[np.searchsorted(each, np.repeat(found, [len(p) for p in places]))]
    order = np.argsort(at, kind="stable")
    at, source = at[order], source[order]
    step = np.diff(at)
    local = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.minimum(step, n))])  # what lies between stretches takes no room
    words = np.empty(local[-1] + n, np.uint64)
    for k in range(n):
        words[local + k] = item[source + k]
    return np.split(words, local[1:][step > n])


def met_places(pairs: DataFrame, seeds: DataFrame, hits: DataFrame) -> DataFrame:
    """For each pair (doc_id, version, item_id, item_version) met: the seeds of the item that the document holds, each with its places. A list is as long as the item has seeds."""
    doc, item = ["doc_id", "version"], ["item_id", "item_version"]
    asked = pairs.join(seeds.select(*item, "seed"), item)
    held = hits.join(pairs.select(*doc).distinct(), doc, "left_semi").dropDuplicates(doc)
    held = held.select(*doc, F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(*doc, F.col("s.seeds").alias("seed"), F.col("s.places").alias("at"))
    return asked.join(held, [*doc, "seed"]).groupBy(*doc, *item).agg(F.collect_list(F.struct("seed", "at")).alias("met"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of document and item whose coverage reaches the threshold: doc_id, item_id, n_item, n_covered, n_tiles, coverage.

    Null or empty texts and items leak nothing; rows without an id are left out.
    Equal rows count once; rows of one id and different texts are searched each by
    itself and the best coverage counts. Empty tables give an empty result. Columns
    other than ids and texts are not read.

    The whole text is scanned once, against a filter of bounded size; only seeds that an
    item may have leave the scan, with their places. Documents and items meet in a join on
    telling seeds: what many items and documents share makes pairs only where it covers
    enough of an item by itself. A pair gets the places of its item's own seeds and no
    other words of the document, so a document that holds many items is not copied for
    each of them. Pairs are dealt out evenly and those whose shared seeds
    cover too few words are not tiled.
    """
    items = materialize(_items(benchmark, item_col, item_text_col), "items")
    seeds = materialize(_item_seeds(items, seed), "item-seeds")
    lengths = sorted(r["n"] for r in seeds.select(F.least(F.col("n_item"), F.lit(seed)).alias("n")).distinct().collect())  # seed values at most
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(seeds, "seed", FILTER_BITS, LEAST_BITS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = sent.value
        for b in batches:
            ids, found, places = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(t)
                hits: list[int] = []
                at: list[list[int]] = []
                for n in lengths:
                    s = gram_hashes(words, n)
                    held = np.flatnonzero(marked.passes(s))
                    if len(held):
                        held = held[np.argsort(s[held], kind="stable")]
                        each, first = np.unique(s[held], return_index=True)
                        hits += each.view(np.int64).tolist()
                        at += [x.tolist() for x in np.split(held, first[1:])]
                if hits:
                    ids.append(i), found.append(hits), places.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(found, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.list_(pa.int32())))], ["doc_id", "seeds", "places"])

    base = texts(docs, id_col, text_col).filter(F.col("doc_id").isNotNull())
    kind, item_kind = base.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    hits = small_batches(base).mapInArrow(scan, f"doc_id {kind}, seeds array<long>, places array<array<int>>")
    hits = materialize(hits.withColumn("version", F.xxhash64("seeds", "places")), "places")
    # pairs that a seed would make, from sums on both sides
    held = hits.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count(F.lit(1)).alias("n_docs"))
    asked = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n_items"))
    heat = held.join(asked, "seed").select("seed", (F.col("n_docs") * F.col("n_items")).alias("heat"))
    of_item = seeds.join(heat, "seed").groupBy("item_id", "item_version").agg(F.collect_list(F.struct("seed", "heat")).alias("heats"))  # at most the item's own seeds

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (item, heats) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                s = telling_seeds(np.array(item, np.int64).view(np.uint64), {h["seed"]: h["heat"] for h in heats}, seed, coverage)
                of = pa.array(np.full(len(s), k))
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(s)], ["item_id", "item_version", "seed"])

    telling = items.join(of_item, ["item_id", "item_version"]).select("item_id", "item_version", "item", "heats")
    telling = small_batches(telling).mapInArrow(choose, f"item_id {item_kind}, item_version long, seed long")
    pairs = hits.select("doc_id", "version", F.explode("seeds").alias("seed")).join(telling, "seed").select("doc_id", "version", "item_id", "item_version").distinct()
    both = met_places(materialize(pairs, "pairs"), seeds, hits).join(items, ["item_id", "item_version"])
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    dealt = both.select("doc_id", "item_id", "met", "item", "version").repartition(parts, "doc_id", "version", "item_id")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            n_covered, n_tiles, n_item = [], [], []
            for met, item in zip(b.column(2), b.column(3).to_pylist()):
                item = np.array(item, np.int64).view(np.uint64)
                n = min(seed, len(item))
                found = met.values.field("seed").to_numpy()
                shared = np.isin(seeds_of(item, seed).view(np.int64), found)
                got = tiles(item, held_words(item, n, found, met.values.field("at").to_pylist()), seed) if cover(len(item), np.flatnonzero(shared), n) / len(item) >= coverage else []
                n_covered.append(sum(n for _, _, n in got)), n_tiles.append(len(got)), n_item.append(len(item))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in (n_item, n_covered, n_tiles))], ["doc_id", "item_id", "n_item", "n_covered", "n_tiles"])

    tiled = small_batches(dealt.drop("version")).mapInArrow(tile, f"doc_id {kind}, item_id {item_kind}, n_item long, n_covered long, n_tiles long")
    share = F.col("n_covered") / F.col("n_item")
    return tiled.withColumn("coverage", share).filter(share >= coverage).groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "n_item", "n_covered", "n_tiles")).alias("best")).select("doc_id", "item_id", "best.n_item", "best.n_covered", "best.n_tiles", "best.coverage")


def flag_documents(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each input row: doc_id, contaminated, n_items, item_id (of the best coverage, then the smallest) and coverage (null if clean)."""
    best = leaks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.min(F.struct((-F.col("coverage")).alias("order"), "item_id")).alias("best"))
    base = docs.select(docs[id_col].alias("doc_id")).join(best, "doc_id", "left")
    return base.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.col("best.item_id").alias("item_id"), (-F.col("best.order")).alias("coverage"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return flag_documents(docs, find_leaks(docs, read_table(spark, sf_dir, "benchmark")))


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLES: dict[str, str] = {}
