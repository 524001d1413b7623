"""N-gram Jaccard join through a forest of MinHash prefix tries, with exact verification.

Texts whose sets of word shingles have a Jaccard similarity of at least THRESHOLD are
linked. Each distinct set gets TREES labels of DEEPEST minimum hashes. A label is a
path in a trie, read from its root; sets that share a prefix meet at a node. The
prefix that must match is shortened, level by level, until the recall that is measured
on planted pairs reaches RECALL: for sets that a hash picks, a partner at the threshold
is made and the longest prefix that the two share in any tree is noted.

Sets that meet are compared by sketches of four bits for each minimum hash first. What
is clearly below the threshold moves no text; the others are compared set against set,
exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.llm.common import materialize, own_exchange, read_table, small_batches, texts
from sparseloom.llm.components import connected_components
from sparseloom.llm.words import WordHashes, gram_hashes, mixed

WORDS, THRESHOLD = 5, 0.8
TREES, DEEPEST, RECALL = 32, 12, 0.9999
#: Sets of one block, and sketches of one; a group of more is split by hash, and blocks are compared two by two.
BLOCK, SKETCHES = 256, 1024
#: Of how many sets one gets a planted partner.
PLANTED = 8
#: Bits of a minimum hash in a sketch, each in a plane of its own; standard errors between the threshold and what a sketch must show: one in 10**8 pairs at the threshold shows less.
PLANES, ERRORS = 4, 5.7

_hashes = WordHashes()


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Distinct hashes of n words in a row, sorted; a text of fewer words is one shingle, one without words has none."""
    words = _hashes.of(text.encode("utf-8").split())
    return np.unique(gram_hashes(words, min(n, len(words)))) if len(words) else np.zeros(0, np.uint64)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a sorted set; sets of equal pairs are taken for equal."""
    place = np.arange(1, len(s) + 1, dtype=np.uint64)
    one = mixed(s + place).sum() + np.uint64(len(s))
    return int(one.view(np.int64)), int(np.bitwise_xor.reduce(mixed(s * (np.uint64(2) * place + np.uint64(1)))).view(np.int64))


def chance(similarity: float, depth: int, trees: int) -> float:
    """That a pair shares a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def matched_prefix(met: dict[int, int], threshold: float, trees: int, deepest: int, recall: float) -> tuple[int, float]:
    """The longest prefix to match that reaches the recall, and the recall measured for it. met: longest shared prefix -> planted pairs.

    From the full label on, a level is taken off until no more planted pairs are lost
    than the target allows, and either enough of them were seen to say so (three
    more losses would still be allowed) or their expected number says the same.
    """
    n = sum(met.values())
    for depth in range(deepest, 0, -1):
        lost = sum(k for level, k in met.items() if level < depth)
        allowed = n * (1 - recall)
        if lost <= allowed + 3 and (lost + 3 <= allowed or chance(threshold, depth, trees) >= recall):
            return depth, 1 - lost / n if n else chance(threshold, depth, trees)
    raise ValueError(f"{trees} trees can't reach a recall of {recall} at {threshold}; take more trees")


def planted(s: np.ndarray, share: Fraction) -> np.ndarray | None:
    """A set at the threshold (or as little above it as a set of that size allows), made from s by taking some shingles out and new ones in; None if only s itself is that similar."""
    swap = int(len(s) * (1 - share) / (1 + share))
    out = swap or int(len(s) * (1 - share))
    if not out:
        return None
    order = np.argsort(mixed(s ^ np.uint64(0x5851F42D4C957F2D)))
    new = mixed(s[order[:swap]] + np.uint64(0x14057B7EF767814F))
    return np.concatenate([s[order[out:]], new])


def _minima(sets: list[np.ndarray], trees: int, deepest: int) -> np.ndarray:
    """For each set, trees times deepest minimum hashes, folded to 16 bits."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, first = np.concatenate(sets), np.cumsum(sizes) - sizes
    flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    rng = np.random.default_rng(11)
    out = np.empty((len(sets), trees * deepest), np.uint16)
    for t in range(trees * deepest):
        a, b = rng.integers(0, 2**32, 2, dtype=np.uint32)
        h = np.minimum.reduceat((flat ^ b) * (a | np.uint32(1)), first)
        out[:, t] = h ^ (h >> np.uint32(16))
    return out


def signatures(docs: DataFrame, trees: int = TREES, deepest: int = DEEPEST, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, s1 and s2 (a hash of the set of shingles), labels (binary, tree by tree), sketch (PLANES bits of each minimum hash, plane by plane, 64 to a number) and met (longest prefix shared with the planted partner, null if there is none). Without words, all but doc_id, s1 and s2 are null."""
    share = Fraction(str(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sets = b.column(0), [shingles(t, n) for t in b.column(1).to_pylist()]
            s1, s2 = np.array([set_hash(s) for s in sets], np.int64).reshape(-1, 2).T
            labels, sketches, met = ([None] * len(sets) for _ in range(3))
            use = [i for i, s in enumerate(sets) if len(s)]
            if use:
                found = _minima([sets[i] for i in use], trees, deepest)
                bits = np.zeros((len(use), PLANES, -(-trees * deepest // 64) * 8), np.uint8)
                for k in range(PLANES):
                    packed = np.packbits((found >> k) & 1, axis=1)
                    bits[:, k, : packed.shape[1]] = packed
                for i, label, sketch in zip(use, found, bits.reshape(len(use), -1).view(np.int64)):
                    labels[i], sketches[i] = label.tobytes(), sketch
                partners = {k: p for k, i in enumerate(use) if s1[i] % PLANTED == 0 and (p := planted(sets[i], share)) is not None}
                if partners:
                    same = (_minima(list(partners.values()), trees, deepest) == found[list(partners)]).reshape(len(partners), trees, deepest)
                    for k, longest in zip(partners, np.logical_and.accumulate(same, 2).sum(2).max(1)):
                        met[use[k]] = int(longest)
            yield pa.RecordBatch.from_arrays([ids, pa.array(s1), pa.array(s2), pa.array(labels, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.array(met, pa.int32())], ["doc_id", "s1", "s2", "labels", "sketch", "met"])

    base = texts(docs, "doc_id", "text")
    return small_batches(base).mapInArrow(run, "doc_id long, s1 long, s2 long, labels binary, sketch array<long>, met int")


def _components_of_pairs(rows: list, linked: np.ndarray) -> np.ndarray:
    """For each row the first row that it hangs together with."""
    root = np.arange(len(rows))
    while True:
        lower = np.minimum(root, np.where(linked, root, len(rows)).min(1, initial=len(rows)))
        lower = lower[lower]
        if (lower == root).all():
            return root
        root = lower


def _dealt(groups: DataFrame, size: DataFrame, key: str) -> DataFrame:
    """Members of groups (key, rep) dealt to blocks by hash; every block meets itself and each other one once: key, blocks, low, high, side, rep. size: key, blocks."""
    dealt = groups.join(size, key).select(key, "rep", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))
    dealt = dealt.select(key, "rep", "blocks", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select(key, "blocks", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"), "rep")


def _units(rows: DataFrame, unit: list[str]) -> DataFrame:
    return small_batches(rows.repartition(*unit).sortWithinPartitions(*unit))


def plausible_groups(signed: DataFrame, sets: DataFrame, depth: int, trees: int, deepest: int, threshold: float) -> DataFrame:
    """node, component: sets that hang together by pairs that share a prefix and whose sketches don't rule the threshold out.

    At each node the sketches are compared with that of the smallest member first. Nodes
    whose members hang together by then, in all trees, are done; others are compared two
    by two, in blocks. Only ids and sketches move.
    """
    hashes, longs = trees * deepest, -(-trees * deepest // 64)
    unlike = (1 - threshold) * (1 - 0.5**PLANES)
    apart = int(hashes * unlike + ERRORS * np.sqrt(hashes * unlike * (1 - unlike)))  # hashes in which a pair may differ
    mine = signed.select(F.col("doc_id").alias("rep"), "s1", "s2", "labels", "sketch").filter(F.col("labels").isNotNull()).join(sets.select("rep", "s1", "s2"), ["rep", "s1", "s2"])
    mine = materialize(mine.select("rep", "labels", "sketch"), "labels")
    sketches = mine.select("rep", "sketch")
    prefix = lambda t: F.xxhash64(t, F.substring("labels", t * (2 * deepest) + 1, F.lit(2 * depth)))
    nodes = mine.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), prefix)).alias("path"))
    shared = nodes.groupBy("path").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).filter("centre != last").select("path", "centre")
    near = materialize(nodes.join(own_exchange(shared, "path"), "path"), "nodes")
    star = near.filter("rep != centre").select("rep", "centre").distinct()
    star = star.join(sketches, "rep").join(sketches.select(F.col("rep").alias("centre"), F.col("sketch").alias("other")), "centre")
    plane = lambda i, k: F.col("sketch")[k * longs + i].bitwiseXOR(F.col("other")[k * longs + i])
    differ = sum((F.bit_count(reduce(Column.bitwiseOR, (plane(i, k) for k in range(PLANES)))) for i in range(longs)), F.lit(0))
    stars = connected_components(star.filter(differ <= apart).select(F.col("rep").alias("a"), F.col("centre").alias("b")))
    of = F.coalesce("component", "rep")
    placed = near.join(stars.withColumnRenamed("node", "rep"), "rep", "left")
    node = placed.groupBy("path").agg(F.min(of).alias("low"), F.max(of).alias("high"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("members")).filter("low != high")
    # nodes of equal members in several trees are one
    open_ = materialize(node.groupBy("n", "members").agg(F.min("path").alias("path")).select("path", F.ceil(F.col("n") / SKETCHES).cast("int").alias("blocks")), "open")
    if open_.isEmpty():
        return stars
    unit = ["path", "blocks", "low", "high"]
    rows = _dealt(near.select("path", "rep"), own_exchange(open_, "path"), "path").join(sketches, "rep").select(*unit, "side", "rep", "sketch")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, {}

        def flush() -> list[tuple[int, int]]:
            found = sorted((rep, side, sketch) for (side, rep), sketch in members.items())
            planes = np.unpackbits(np.array([r[2] for r in found], np.int64).view(np.uint8).reshape(len(found), PLANES, -1), axis=2)
            values = sum(planes[:, k] << k for k in range(PLANES)).T.copy()  # a row for each hash
            differ = np.zeros((len(found), len(found)), np.uint16)
            for v in values:
                differ += v[:, None] != v
            linked = differ <= apart
            np.fill_diagonal(linked, False)
            if key[2] != key[3]:  # two blocks: pairs of one block are those of another unit
                side = np.array([r[1] for r in found])
                linked &= side[:, None] != side
            root = _components_of_pairs(found, linked)
            return [(found[i][0], found[r][0]) for i, r in enumerate(root) if i != r]

        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], ["a", "b"])

        for b in batches:
            for path, blocks, low, high, side, rep, sketch in zip(*(c.to_pylist() for c in b.columns)):
                if key != (path, blocks, low, high):
                    if members and (pairs := flush()):
                        yield out(pairs)
                    key, members = (path, blocks, low, high), {}
                members[side, rep] = sketch
        if members and (pairs := flush()):
            yield out(pairs)

    more = _units(rows, unit).mapInArrow(compare, "a long, b long")
    return connected_components(more.union(stars.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _within(rows: list[tuple], across: bool, share: Fraction) -> Iterator[tuple[int, int, int]]:
    """Exact comparison of one unit: (block side, id, copies, set) rows, of two blocks if across. Yields id, linked documents, smallest id it hangs together with here."""
    rows.sort(key=lambda r: r[1])
    sets = [r[3] for r in rows]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    values, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(held > 1) - 1  # shingles that one set alone has say nothing about pairs
    shared = held[column] > 1
    column, owner = place[column[shared]], owner[shared]
    common = np.zeros((len(rows), len(rows)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (start, start + width))
        x = np.zeros((len(rows), width), np.float32)
        x[owner[i:j], column[i:j] - start] = 1
        common += x @ x.T
    common = common.astype(np.int64)
    linked = common * share.denominator >= share.numerator * (sizes[:, None] + sizes - common)
    np.fill_diagonal(linked, False)
    side = np.array([r[0] for r in rows])
    if across:  # two blocks: pairs of one block are those of another unit
        linked &= side[:, None] != side
    copies = np.array([r[2] for r in rows], np.int64)
    number = linked @ copies
    root = _components_of_pairs(rows, linked)
    for i, r in enumerate(rows):
        yield r[1], int(number[i]), rows[root[i]][1]


def measured_prefixes(signed: DataFrame) -> dict[int, int]:
    """Longest prefix that a planted pair shares -> pairs."""
    return {r["met"]: r["n"] for r in signed.filter(F.col("met").isNotNull()).groupBy("met").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each level


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (smallest id among the documents linked to it, directly or by others; its own if none), n_links (other documents at the threshold).

    Documents without words (null, empty or blank texts) are equal to each other and to
    no others. Rows without
    an id are left out; rows of one id are one document, and if their texts differ, one
    of these (the same in every run) stands for it. An empty table gives an empty result. Ids are whole
    numbers; other columns than id and text are not read.

    Documents of equal sets are represented by one of them. Sets that meet in a trie are
    told apart by sketches; those that hang together by pairs that may reach the
    threshold are compared in blocks, all pairs of them inside tasks, and only sums and
    one edge for each set come out. No cap is set on groups. Hot sets and nodes are
    summed before they are shuffled.
    """
    base = texts(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text").filter("doc_id IS NOT NULL")
    signed = materialize(signatures(base, trees, DEEPEST, n, threshold), "signatures")
    members = signed.groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("s")).select("doc_id", "s.s1", "s.s2")
    sets = members.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    sets = materialize(sets, "sets")
    depth, _ = matched_prefix(measured_prefixes(signed), threshold, trees, DEEPEST, recall)
    groups = plausible_groups(signed, sets, depth, trees, DEEPEST, threshold).withColumnRenamed("node", "rep")
    groups = materialize(groups, "groups")
    size = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = _dealt(groups, size, "component").join(sets.select("rep", "copies", "s1"), "rep")
    units = dealt.join(base.withColumnRenamed("doc_id", "rep"), "rep")
    share = Fraction(str(threshold))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, {}, []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rows, out
            if rows:
                out += [(r, k, p, key[1] > 1) for r, k, p in _within(list(rows.values()), key[2] != key[3], share)]
                rows = {}
            if out and (last or len(out) > 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["rep", "links", "root", "open"])
                out = []

        for b in batches:
            for component, blocks, low, high, side, rep, copies, s1, text in zip(*(c.to_pylist() for c in b.columns)):
                if key != (component, blocks, low, high):
                    yield from flush(False)
                    key = (component, blocks, low, high)
                found = shingles(text, n)
                if set_hash(found)[0] == s1:  # not of another row of that id
                    rows[side, rep] = (side, rep, copies, found)
        yield from flush(True)

    unit = ["component", "blocks", "low", "high"]
    compared = _units(units.select(*unit, "side", "rep", "copies", "s1", "text"), unit).mapInArrow(compare, "rep long, links long, root long, open boolean")
    compared = materialize(compared, "compared")
    links = compared.groupBy("rep").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.bool_or("open").alias("open"))
    closed = links.filter("NOT open AND links > 0").select("rep", "root")
    across = compared.filter("open AND rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    classes = closed
    if not across.isEmpty():  # groups of several blocks are put together from the edges of their units
        classes = closed.union(connected_components(across).select(F.col("node").alias("rep"), F.col("component").alias("root")))
    per_set = sets.join(links.select("rep", "links"), "rep", "left").join(classes, "rep", "left").select("s1", "s2", "rep", "copies", "links", "root")
    return members.join(per_set, ["s1", "s2"]).select(
        "doc_id", F.coalesce("root", "rep").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, n, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS s
      FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, s FROM g WHERE s IS NOT NULL
      UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM c JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 10 * k >= 8 * (x.n + y.n - k)
      UNION ALL SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON len(x.ws) = len(y.ws) AND x.doc_id <> y.doc_id WHERE len(x.ws) = 0),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
m AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a)
SELECT doc_id, class_id, (SELECT count(*) FROM p WHERE p.a = m.doc_id)::BIGINT AS n_links FROM m
"""

QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLES = {"op3_jaccard_join": SQL}
