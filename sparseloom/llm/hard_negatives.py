"""Hard negatives by inner products, with coordinate pruning in length buckets.

Vectors lie in buckets of similar length, each with a sorted list of every coordinate of
its normalized vectors. An anchor with a score to reach (theta) has a cosine to reach in
each bucket, theta / (its length x the longest vector of the bucket); buckets where that
exceeds 1 are passed over. On the anchor's focus coordinates, the largest of its
normalized vector, that cosine leaves a feasible range each; the ranges are looked up
in the sorted lists, the sets intersected, and only what is left is multiplied out.

Buckets are met in steps, those of long vectors first: each step raises theta to the
k-th best score found so far, so later (larger) steps find little that is not needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparseloom.llm.common import hash128, materialize, own_exchange, read_table

#: Vectors of a bucket (its lists fit into a cache), anchors that meet it together, coordinates whose ranges are looked up, and how many times more buckets each step takes.
BUCKET, BLOCK, FOCUS, GROWTH = 512, 1024, 4, 16
POSITIVES, NEGATIVES = 5, 10
#: Buckets hold lengths within a factor of 2**(1 / LENGTHS).
LENGTHS = 8
_SLACK = 1e-9


def prepare(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, vec (whole numbers, floor(256 x)), tag (a hash of vec, which tells rows of one id and label apart) and len, without rows that take no part.

    Those are rows with a null label, id or vector, or any null or non-finite component.
    Rows that agree in id, label and vector are one row.
    """
    x = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"), vectors[vec_col].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform("v", lambda c: F.rint(F.lit(256.0) * c - F.pmod(F.lit(256.0) * c, F.lit(1.0))) + F.lit(0.0))
    ok = x.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(finite)
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, c: s + c * c))
    return ok.select("id", "label", whole.alias("vec")).distinct().withColumns({"len": length, "tag": F.xxhash64("vec")})


def _class_of(df: DataFrame) -> DataFrame:
    h1, h2 = hash128(F.col("label"), F.col("vec"))
    return df.withColumns({"h1": h1, "h2": h2})


def _level(length: Column) -> Column:
    """Number of the length class; that of zero vectors is the smallest."""
    return F.when(length > 0, F.floor(F.log2(length) * LENGTHS)).otherwise(F.lit(-1_000_000)).cast("int")


def buckets(rows: DataFrame, group: Column, queries: DataFrame, query_group: Column, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """The rows of groups that some query searches, with their bucket: grp, no (from 0, longest vectors first) and blocks, into how many blocks the group's queries are dealt.

    A length class is split by hash into as many buckets as its exact count asks for, so no
    bucket outgrows a task, however many vectors have the same length or label.
    """
    r = rows.withColumns({"grp": group, "level": _level(F.col("len"))})
    asked = queries.select(query_group.alias("grp")).groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    sizes = r.groupBy("grp", "level").agg(F.ceil(F.count(F.lit(1)) / bucket).cast("long").alias("parts"))
    before = Window.partitionBy("grp").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)  # some thousand lengths at most
    first = sizes.join(asked, "grp").withColumn("first", F.coalesce(F.sum("parts").over(before), F.lit(0)))
    met = r.join(own_exchange(first, "grp"), ["grp", "level"])
    return met.select("grp", (F.col("first") + F.pmod(F.xxhash64("vec", "id"), F.col("parts"))).alias("no"), "blocks", "id", "tag", "label", "vec", "len")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows: cut to, or filled up with zeros to the width of the longest anchor, beyond which every product is 0."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(x.offsets.to_numpy())
    flat = x.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = at < width
    out[row[inside], at[inside]] = flat[inside]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for whole numbers, exact whatever their size: in Python's integers where floats could round."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, len(b))
    if most < 2**52:
        return (a @ b).astype(np.int64)
    return np.array([sum(int(x) * int(y) for x, y in zip(row, b)) for row in a], object)


class Lists:
    """A bucket: vectors, and a sorted list of each coordinate of the normalized ones."""

    def __init__(self, vec: np.ndarray):
        self.vec, self.length = vec, np.sqrt((vec * vec).sum(1))
        unit = vec / np.maximum(self.length, 1e-300)[:, None]
        self.order = np.argsort(unit, 0, kind="stable")
        self.value = np.take_along_axis(unit, self.order, 0)

    def candidates(self, q: np.ndarray, theta: float, focus: int = FOCUS) -> np.ndarray:
        """Rows that may reach theta: none that does is missing."""
        n, size = len(self.vec), math.sqrt(float((q * q).sum()))
        every = np.arange(n)
        if theta == -math.inf:
            return every
        longest, shortest = (float(f(self.length, initial=i)) for f, i in ((np.max, 0), (np.min, math.inf)))
        base = size * (longest if theta > 0 else shortest)
        if base == 0:
            return every if theta <= 0 else every[:0]
        cosine = theta / base - _SLACK * (1 + abs(theta / base))
        if cosine > 1:
            return every[:0]
        if cosine <= -1 or shortest == 0:  # a zero vector has no direction
            return every
        unit, angle = q / size, math.acos(cosine)
        met = np.zeros(n, np.uint8)
        chosen = np.argsort(-np.abs(unit), kind="stable")[:focus]
        for f in chosen:
            own = math.acos(max(-1.0, min(1.0, float(unit[f]))))
            low, high = math.cos(min(math.pi, own + angle)) - _SLACK, math.cos(max(0.0, own - angle)) + _SLACK
            column = self.value[:, f]
            met[self.order[np.searchsorted(column, low) : np.searchsorted(column, high, "right"), f]] += 1
        return np.flatnonzero(met == len(chosen))


def _best(score: np.ndarray, ids: np.ndarray, tags: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((tags, ids, -score if score.dtype != object else np.array([-s for s in score], object)))[:k]


def _search_bucket(left: pa.Table, right: pa.Table, k: int, same: bool) -> pa.Table:
    """The first k rows of a bucket in each window of each anchor."""
    width = max((len(v) for v in left.column("vec")), default=0)
    lists, ids, tags, labels = Lists(_matrix(right.column("vec"), width)), *(right.column(c).to_numpy() for c in ("id", "tag", "label"))
    out: tuple[list, ...] = ([], [], [], [], [], [])
    for h1, h2, q, label, windows in zip(*(left.column(c).to_pylist() for c in ("h1", "h2")), _matrix(left.column("vec"), width), *(left.column(c).to_pylist() for c in ("label", "windows"))):
        lows = [w["low"] for w in windows]
        found = lists.candidates(q, -math.inf if None in lows else float(min(lows)))
        found = found[(labels[found] == label) == same]
        if not len(found):
            continue
        score, its, tag = products(lists.vec[found], q), ids[found], tags[found]
        for w in windows:
            inside = np.ones(len(found), bool)
            if w["low"] is not None:
                inside &= score >= w["low"]
            if w["high"] is not None:
                inside &= score <= w["high"]
            at = np.flatnonzero(inside)
            at = at[_best(score[at], its[at], tag[at], k)]
            for c, x in zip(out, ([h1] * len(at), [h2] * len(at), [w["no"]] * len(at), its[at].tolist(), tag[at].tolist(), [int(s) for s in score[at]])):
                c.extend(x)
    return pa.table({n: pa.array(c, pa.int32() if n == "w" else pa.int64()) for n, c in zip(("h1", "h2", "w", "id", "tag", "score"), out)})


_FOUND = "h1 long, h2 long, w int, id long, tag long, score long"


def search(queries: DataFrame, dealt: DataFrame, k: int, same: bool, group: Column) -> DataFrame:
    """For each window of each query the first k rows (score descending, then id) of its group with a score within it: h1, h2, w, id, tag, score.

    queries: h1, h2 (their key), label, vec, len, windows, an array of (no, low, high) with
    a null bound where there is none. dealt: what buckets() made. same: whether rows of the
    query's label or of all others count. A query meets a bucket in one task, with at most a
    block of queries; each step keeps k rows of each window.
    """
    spark = queries.sparkSession
    dealt = materialize(dealt, "buckets")
    most = dealt.agg(F.max("no")).first()[0]
    asked = queries.withColumn("grp", group)
    spans = dealt.groupBy("grp").agg(F.max("no").alias("last"), F.first("blocks").alias("blocks"))
    asked = materialize(asked.join(own_exchange(spans, "grp"), "grp").withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks"))), "queries")
    found = spark.createDataFrame([], _FOUND)
    low, high = 0, 1
    order = Window.partitionBy("h1", "h2", "w").orderBy(F.desc("score"), "id", "tag")
    while most is not None and low <= most:
        reached = found.groupBy("h1", "h2", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
        reached = reached.groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("least"))
        now = asked.filter(F.col("last") >= low).join(reached, ["h1", "h2"], "left")
        raised = F.transform("windows", lambda w: F.struct(w["no"].alias("no"), F.greatest(w["low"], F.col("least")[w["no"]]).alias("low"), w["high"].alias("high")))
        steps = F.explode(F.sequence(F.lit(low).cast("long"), F.least(F.col("last"), F.lit(high - 1).cast("long")))).alias("no")
        left = now.select("grp", "block", steps, "h1", "h2", "label", "vec", raised.alias("windows"))
        some = dealt.filter((F.col("no") >= low) & (F.col("no") < high))
        right = some.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long"))).alias("block"), "no", "id", "tag", "label", "vec")
        keys = ("grp", "block", "no")
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _search_bucket(a, b, k, same), _FOUND)
        best = found.union(met).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found = materialize(best.select("h1", "h2", "w", "id", "tag", "score"), "found")
        low, high = high, high * GROWTH
    return found


def hard_negatives(vectors: DataFrame, is_anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from what prepare() made.

    is_anchor: which rows (by their column id) are anchors. Positives are the first
    n_positives other rows of the anchor's label; the negatives of a positive are the
    first n_negatives rows of other labels with low * positive_score <= 100 *
    negative_score <= high * positive_score (none where positive_score is negative). Higher
    scores come first, ties by the smaller id. Vectors of unlike lengths are filled up with
    zeros; a score that needs more than 64 bits is an error. No rows, anchors or labels:
    no result.

    Anchors with the same label and vector are searched once, and of rows with the same
    label and vector the first few of each part are enough, as their scores are the same.
    """
    rows = materialize(_class_of(vectors), "vectors")
    part = Window.partitionBy("h1", "h2", F.pmod(F.xxhash64("id"), F.lit(16))).orderBy("id")
    few = rows.withColumn("k", F.row_number().over(part)).filter(F.col("k") <= max(n_positives + 1, n_negatives)).select("id", "tag", "label", "vec", "len")
    anchors = rows.filter(is_anchor).select("id", "tag", "h1", "h2")
    asked = rows.filter(is_anchor).dropDuplicates(["h1", "h2"]).select("h1", "h2", "label", "vec", "len")
    bound = lambda x: F.lit(x).cast("long")
    window = lambda no, a, b: F.struct(no.cast("int").alias("no"), a.alias("low"), b.alias("high"))
    first = asked.withColumn("windows", F.array(window(F.lit(0), bound(None), bound(None))))
    near = search(first, buckets(few, F.col("label"), first, F.col("label")), n_positives + 1, True, F.col("label"))
    # one window for each positive that some anchor of the class may take
    of = near.withColumn("no", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id", "tag")).cast("int"))
    of = materialize(of.select("h1", "h2", "no", F.col("id").alias("positive_id"), "tag", F.col("score").alias("positive_score")), "positives")
    s = F.col("positive_score")
    least, greatest = -F.floor(F.expr(f"(-{low} * cast(positive_score AS decimal(20,0))) / 100")), F.floor(F.expr(f"({high} * cast(positive_score AS decimal(20,0))) / 100"))
    wins = of.filter(s >= 0).groupBy("h1", "h2").agg(F.collect_list(window(F.col("no"), least.cast("long"), greatest.cast("long"))).alias("windows"))
    second = asked.join(wins, ["h1", "h2"])
    all_ = F.lit(0).cast("long")
    far = search(second, buckets(few, all_, second, all_), n_negatives, False, all_)
    ranked = far.withColumn("rank", F.row_number().over(Window.partitionBy("h1", "h2", "w").orderBy(F.desc("score"), "id", "tag")).cast("int"))
    ranked = ranked.select("h1", "h2", F.col("w").alias("no"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    # an anchor is none of its own positives
    own = anchors.select("h1", "h2", F.col("id").alias("anchor_id"), F.col("tag").alias("own")).join(of, ["h1", "h2"]).filter("anchor_id != positive_id OR own != tag")
    taken = own.withColumn("k", F.row_number().over(Window.partitionBy("h1", "h2", "anchor_id").orderBy("no"))).filter(F.col("k") <= n_positives)
    return taken.join(ranked, ["h1", "h2", "no"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(prepare(rows.withColumn("label", label)), F.col("id") % 100 == 0)


SQL = """
WITH e AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.id % 100 = 0 AND a != b),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES = {"op13_hard_negatives": SQL}
