"""Queries over the given tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.functions.expressions import ftrl_weight, ftrl_z, log_loss, number_text, sgn, sigmoid
from sparseloom.functions.metrics import mean_loss
from sparseloom.functions.params import EncodeParams, Params
from sparseloom.operators import encode as enc
from sparseloom.draws_sql import DRAW, SIGNED, UNIFORM, hashed
from sparseloom.operators.filters import has_zero, in_range, nonzero
from sparseloom.operators.model import Model, empty_model, export_text, import_text, initial_factors, initial_weight, load_model, save_model, zero_weights
from sparseloom.operators.order import row_partitions, with_positions
from sparseloom.operators.score import logits, predict
from sparseloom.operators.sparse_model import sparse_linear, sparse_logits
from sparseloom.plans.batch import batch_step, ffm_gradients, fm_gradients, scored_rows, train_batch
from sparseloom.plans.bucketed import train_bucketed
from sparseloom.plans.mixing import mixing_round
from sparseloom.plans.tasks import run as run_task
from sparseloom.sources.line_stream import bounded_lines
from sparseloom.sources.sparse_text import line_formats, parse_by_pattern, parse_garbage_as_zero, parse_samples, read_lines, with_chunks, write_lines
from sparseloom.sources.tabular import read_train_eval, split
from sparseloom.storage import materialize, scratch_path
from sparseloom.streaming.fold import fold_stream, folded_model
from sparseloom.streaming.online import latest_model, stream_lines, train_stream

THRESHOLD = 60
K = 4
#: All features that an int can be: their numbers follow the data, and a smaller bound would drop those beyond it.
N_FEATS = 1 << 31


def params(model: str = "LR", **more) -> Params:
    return Params(model_type=model, n_feats=N_FEATS, n_fields=3, n_factors=K, w_alpha=0.05, init_stddev=0.05, **more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")


CAT = ["event_type", "user_id"]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_samples(spark, sf_dir)[0]


def numbered_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Events as samples, and the number of their features: type and user as categories, the normalised value as a number."""
    e = events(spark, sf_dir)
    words = materialize(enc.dictionaries(e, CAT), "words")
    first = (words.agg(F.max("feat")).first()[0] or 0) + 1
    scaled = enc.min_max(e.withColumn("given", F.col("value")), enc.bounds(e, ["value"]), ["value"])
    return enc.encode(scaled, words, first, CAT, ["value"], F.when(F.col("given") > THRESHOLD, 1).otherwise(0), "event_id"), first + 1


#: The same as rows of d: event_id, y, a and b (category numbers), c (number of the value), x (the value).
D = f"""
t AS (SELECT event_type AS v, row_number() OVER (ORDER BY event_type) AS f FROM (SELECT DISTINCT event_type FROM events)),
u AS (SELECT user_id AS v, (SELECT count(*) FROM t) + row_number() OVER (ORDER BY user_id) AS f FROM (SELECT DISTINCT user_id FROM events)),
m AS (SELECT min(value) AS lo, max(value) AS hi, (SELECT count(*) FROM t) + (SELECT count(*) FROM u) + 1 AS c FROM events),
d AS (SELECT event_id, CASE WHEN value > {THRESHOLD} THEN 1 ELSE 0 END AS y, t.f AS a, u.f AS b, m.c AS c, ((value - lo) / (hi - lo))::FLOAT::DOUBLE AS x
      FROM events JOIN t ON event_type = t.v JOIN u ON user_id = u.v CROSS JOIN m)"""


def formula_model(spark: SparkSession, kind: str, n_feats: int) -> Model:
    """Weights from a rule, for all features of the data, so that scores can be computed elsewhere."""
    feat = spark.range(-1, n_feats).select(F.col("id").cast("int").alias("feat"))
    w = F.when(F.col("feat") == -1, 0.1).otherwise((F.pmod(F.col("feat") * 37, F.lit(101)) - 50) / 1000.0)
    linear = feat.select("feat", w.alias("w"), F.lit(0.0).alias("n"), F.lit(0.0).alias("z"))
    if kind == "LR":
        return Model(params(kind), linear)
    zero = F.array(*[F.lit(0.0)] * K)
    feat = feat.filter("feat >= 0")
    if kind == "FM":
        v = F.array(*((F.pmod(F.col("feat") * 31 + k * 17, F.lit(97)) - 48) / 500.0 for k in range(K)))
        return Model(params(kind), linear, feat.select("feat", v.alias("v"), zero.alias("n"), zero.alias("z")))
    v = F.array(*((F.pmod(F.col("feat") * 13 + F.col("field") * 29 + k * 7, F.lit(89)) - 44) / 400.0 for k in range(K)))
    feat = feat.select("feat", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("field"))
    return Model(params(kind), linear, feat.select("feat", "field", v.alias("v"), zero.alias("n"), zero.alias("z")))


def _w(f: str) -> str:
    return f"((({f} * 37) % 101 - 50) / 1000.0::DOUBLE)"


def _v(f: str, k: int) -> str:
    return f"((({f} * 31 + {k * 17}) % 97 - 48) / 500.0::DOUBLE)"


def _vf(f: str, field: int, k: int) -> str:
    return f"((({f} * 13 + {field * 29 + k * 7}) % 89 - 44) / 400.0::DOUBLE)"


LINEAR = f"(0.1::DOUBLE + {_w('a')} + {_w('b')} + {_w('c')} * x)"
FM = LINEAR + "".join(f" + 0.5 * (({_v('a', k)} + {_v('b', k)} + {_v('c', k)} * x) * ({_v('a', k)} + {_v('b', k)} + {_v('c', k)} * x) - {_v('a', k)} * {_v('a', k)} - {_v('b', k)} * {_v('b', k)} - {_v('c', k)} * x * {_v('c', k)} * x)" for k in range(K))
FFM = LINEAR + "".join(f" + {_vf('a', 1, k)} * {_vf('b', 0, k)} + {_vf('a', 2, k)} * {_vf('c', 0, k)} * x + {_vf('b', 2, k)} * {_vf('c', 1, k)} * x" for k in range(K))

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# encoding


@query(f"SELECT event_id, CASE WHEN value > {THRESHOLD} THEN 1 ELSE 0 END AS y FROM events")
def label_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", enc.label(EncodeParams(threshold=THRESHOLD), F.col("value")).alias("y"))


@query("SELECT event_id, 1 AS y FROM events")
def implicit_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", enc.label(EncodeParams(neg_sampling=True), F.col("value")).alias("y"))


@query(f"WITH {D} SELECT 0 AS field, v AS value, f::INTEGER AS feat FROM t UNION ALL SELECT 1, v::VARCHAR, f::INTEGER FROM u")
def category_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enc.dictionaries(events(spark, sf_dir), CAT)


@query(f"WITH {D} SELECT 0 AS field, count(*) AS cardinality, 1::BIGINT AS start FROM t UNION ALL SELECT 1, count(*), (SELECT count(*) FROM t) + 1 FROM u")
def feature_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enc.offsets(enc.dictionaries(events(spark, sf_dir), CAT), 2)


@query("""
WITH r AS (SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey % 10 < 8),
n AS (SELECT p_name AS v, row_number() OVER (ORDER BY p_name) AS f FROM (SELECT DISTINCT p_name FROM r)),
b AS (SELECT p_brand AS v, (SELECT count(*) FROM n) + row_number() OVER (ORDER BY p_brand) AS f FROM (SELECT DISTINCT p_brand FROM r))
SELECT p_partkey AS seq, coalesce(n.f, 0)::INTEGER AS name_feat, coalesce(b.f, 0)::INTEGER AS brand_feat
FROM part LEFT JOIN n ON p_name = n.v LEFT JOIN b ON p_brand = b.v""")
def categorical_encode_oov(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    words = enc.dictionaries(part.filter("p_partkey % 10 < 8"), ["p_name", "p_brand"])
    x = enc.encode(part, words, 0, ["p_name", "p_brand"], [], F.lit(1), "p_partkey")
    return x.select("seq", F.col("x")[0].feat.alias("name_feat"), F.col("x")[1].feat.alias("brand_feat"))


@query("""
WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderkey % 10 < 8)
SELECT o_orderkey, round((o_totalprice - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END), 6) AS price FROM orders CROSS JOIN m""")
def minmax_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    scaled = enc.min_max(orders, enc.bounds(orders.filter("o_orderkey % 10 < 8"), ["o_totalprice"]), ["o_totalprice"])
    return scaled.select("o_orderkey", F.round("o_totalprice", 6).alias("price"))


def _line(*items: tuple[str, str]) -> str:
    """SQL of a line; numbers are quarters, so four decimals are exact."""
    return f"WITH {D} SELECT event_id AS seq, y || ' ' || " + " || ' ' || ".join(f"'{field}' || {feat} || ':1.0'" for field, feat in items) + " || ' ' "


QUARTER = "regexp_replace(printf('%.4f', floor(x * 4) / 4), '(\\.\\d+?)0+$', '\\1')"


def quarter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose numbers are rounded down to quarters: exact in any text."""
    down = lambda e: F.struct(e.field.alias("field"), e.feat.alias("feat"), (F.floor(e.value * 4) / 4).cast("float").alias("value"))
    return samples(spark, sf_dir).withColumn("x", F.transform("x", down))


@query(_line(("", "a"), ("", "b")) + f"|| c || ':' || {QUARTER} AS value FROM d")
def format_libsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enc.lines(quarter_samples(spark, sf_dir), "libsvm")


@query(_line(("0:", "a"), ("1:", "b")) + f"|| '2:' || c || ':' || {QUARTER} AS value FROM d")
def format_libffm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enc.lines(quarter_samples(spark, sf_dir), "libffm")


def _parsed(spark: SparkSession, sf_dir: str, file_type: str) -> DataFrame:
    got = parse_samples(enc.lines(quarter_samples(spark, sf_dir), file_type), file_type)
    return got.select("seq", "y", F.explode("x").alias("e")).select("seq", "y", "e.field", "e.feat", F.col("e.value").cast("double").alias("value"))


def _parsed_sql(fields: tuple[int, int, int]) -> str:
    rows = [f"SELECT event_id AS seq, y, {field} AS field, {feat}::INTEGER AS feat, {value}::DOUBLE AS value FROM d" for field, (feat, value) in zip(fields, (("a", "1"), ("b", "1"), ("c", "floor(x * 4) / 4")))]
    return f"WITH {D} SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE value <> 0"


@query(_parsed_sql((0, 0, 0)))
def parse_libsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "libsvm")


@query(_parsed_sql((0, 1, 2)))
def parse_libffm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "libffm")


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'libsvm' ELSE 'libffm' END AS file_type, count(*) AS n_lines FROM events GROUP BY 1")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return line_formats(enc.lines(s.filter("seq % 3 = 0"), "libsvm").union(enc.lines(s.filter("seq % 3 != 0"), "libffm")))


# filters

BAND = 40


@query(f"WITH {D} SELECT event_id AS seq, 2 + CASE WHEN floor(x * 4) <> 0 THEN 1 ELSE 0 END AS n FROM d")
def drop_zero_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarter_samples(spark, sf_dir).select("seq", F.size(nonzero(F.col("x"))).alias("n"))


@query(f"WITH {D} SELECT event_id AS seq, (a < {BAND})::INTEGER + (b < {BAND})::INTEGER + (c < {BAND})::INTEGER AS n FROM d")
def range_filter_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("seq", F.size(in_range(F.col("x"), BAND)).alias("n"))


@query(f"WITH {D} SELECT event_id AS seq, (a < {BAND})::INTEGER + (b < {BAND})::INTEGER AS n FROM d")
def range_filter_ffm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("seq", F.size(in_range(F.col("x"), BAND, 2)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, bool_or(l_discount = 0) AS has_zero FROM lineitem GROUP BY ALL")
def has_zero_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.bool_or(F.col("l_discount") == 0).alias("has_zero"))


@query("SELECT bool_or(l_discount = 0) AS has_zero FROM lineitem")
def has_zero_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return has_zero(table(spark, sf_dir, "lineitem"), "l_discount")


@query("SELECT part, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, floor((row_number() OVER (ORDER BY o_orderkey) - 1) / ceil((SELECT count(*) FROM orders) / 7.0))::INTEGER AS part FROM orders) GROUP BY part")
def row_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in seven ranges of equally many rows; their keys have gaps."""
    dealt = row_partitions(table(spark, sf_dir, "orders").select("o_orderkey"), 7, "o_orderkey")
    return dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders")
def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return with_positions(orders, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "position")


# functions


@query("SELECT event_id, CASE WHEN value > 100 THEN 1 ELSE -1 END AS sgn, round(1 / (1 + exp(-(value - 100) / 50)), 9) AS sigmoid FROM events")
def sgn_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") - 100
    return events(spark, sf_dir).select("event_id", sgn(v).alias("sgn"), F.round(sigmoid(v / 50), 9).alias("sigmoid"))


@query("""
SELECT event_id, round(CASE WHEN abs(z) <= 0.1 THEN 0 ELSE -(z - (CASE WHEN z > 0 THEN 1 ELSE -1 END) * 0.1) / (5 + (1 + sqrt(value)) / 0.05) END, 9) AS w
FROM (SELECT event_id, value, (event_id % 41 - 20) / 8.0::DOUBLE AS z FROM events)""")
def ftrl_prox(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = (F.col("event_id") % 41 - 20) / 8.0
    return events(spark, sf_dir).select("event_id", F.round(ftrl_weight(F.col("value"), z, params()), 9).alias("w"))


# scores


def _logits(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    given, n = numbered_samples(spark, sf_dir)
    return logits(given, formula_model(spark, kind, n))


@query(f"WITH {D} SELECT event_id AS seq, round({LINEAR}, 9) AS logit FROM d")
def linear_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir, "LR").select("seq", F.round("logit", 9).alias("logit"))


@query(f"WITH {D} SELECT event_id AS seq, round({FM}, 9) AS logit FROM d")
def fm_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir, "FM").select("seq", F.round("logit", 9).alias("logit"))


@query(f"WITH {D} SELECT event_id AS seq, round({FFM}, 9) AS logit FROM d")
def ffm_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir, "FFM").select("seq", F.round("logit", 9).alias("logit"))


@query(f"WITH {D} SELECT event_id AS seq, y, round(1 / (1 + exp(-({FFM}))), 9) AS prediction FROM d")
def predict_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, n = numbered_samples(spark, sf_dir)
    return predict(given, formula_model(spark, "FFM", n), output_prob=True).select("seq", "y", F.round("prediction", 9).alias("prediction"))


LOSS = "CASE WHEN y = 1 THEN ln(1 + exp(-logit)) ELSE ln(1 + exp(logit)) END"


@query(f"WITH {D} SELECT event_id AS seq, round({LOSS}, 9) AS loss FROM (SELECT event_id, y, {FM} AS logit FROM d)")
def logloss_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir, "FM").select("seq", F.round(log_loss(F.col("y"), F.col("logit")), 9).alias("loss"))


@query(f"WITH {D} SELECT round(avg({LOSS}), 9) AS loss, count(*) AS n FROM (SELECT y, {FFM} AS logit FROM d)")
def mean_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mean_loss(_logits(spark, sf_dir, "FFM")).select(F.round("loss", 9).alias("loss"), "n")


@query(f"WITH {D} SELECT (event_id // 2000)::BIGINT AS chunk, round(avg({LOSS}), 9) AS loss, count(*) AS n FROM (SELECT event_id, y, {LINEAR} AS logit FROM d) GROUP BY 1")
def online_chunk_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = with_chunks(_logits(spark, sf_dir, "LR"), 2000)
    return chunks.groupBy("chunk").agg(F.round(F.avg(log_loss(F.col("y"), F.col("logit"))), 9).alias("loss"), F.count(F.lit(1)).alias("n"))


# training


def _rounded(model: DataFrame) -> DataFrame:
    return model.select("feat", F.round("w", 8).alias("w"), F.round("n", 6).alias("n"), F.round("z", 6).alias("z"))


def _steps_head(x: str = "x") -> str:
    """e holds entries with the bias, s0 the weights at the start."""
    return f"""WITH {D},
e AS (SELECT event_id, y, -1 AS f, 1.0::DOUBLE AS x FROM d UNION ALL SELECT event_id, y, a, 1 FROM d UNION ALL SELECT event_id, y, b, 1 FROM d UNION ALL SELECT event_id, y, c, {x} FROM d),
s0 AS (SELECT DISTINCT f, 0.0::DOUBLE AS n, 0.0::DOUBLE AS z, 0.0::DOUBLE AS w FROM e)"""


def _logit_sql(name: str, state: str, where: str) -> str:
    return f""",
{name} AS (SELECT event_id, any_value(y) AS y, sum(w * x) AS logit, 1 / (1 + exp(-sum(w * x))) - any_value(y) AS err FROM e JOIN {state} USING (f) WHERE {where} GROUP BY event_id)"""


def _step_sql(i: int, where: str = "TRUE") -> str:
    """Step i over the samples of a condition: r<i> has logits before it, s<i + 1> sums and weights after it."""
    return _logit_sql(f"r{i}", f"s{i}", where) + f""",
g{i} AS (SELECT f, sum(err * x) AS g, sum(err * x * err * x) AS q FROM e JOIN r{i} USING (event_id) GROUP BY f),
h{i} AS (SELECT f, n + coalesce(q, 0) AS n, z + coalesce(g, 0) - (sqrt(n + coalesce(q, 0)) - sqrt(n)) / 0.05 * w AS z FROM s{i} LEFT JOIN g{i} USING (f)),
s{i + 1} AS (SELECT f, n, z, (CASE WHEN abs(z) <= 0.1 THEN 0 ELSE -(z - (CASE WHEN z > 0 THEN 1 ELSE -1 END) * 0.1) / (5 + (1 + sqrt(n)) / 0.05) END) AS w FROM h{i})"""


def _epochs_steps_sql(epochs: int, x: str = "x") -> str:
    return _steps_head(x) + "".join(_step_sql(i) for i in range(epochs))


def _epochs_sql(epochs: int) -> str:
    return _epochs_steps_sql(epochs) + f" SELECT f::INTEGER AS feat, round(w, 8) AS w, round(n, 6) AS n, round(z, 6) AS z FROM s{epochs}"


@query(_epochs_sql(1))
def ftrl_batch_step_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(train_batch(materialize(samples(spark, sf_dir), "samples"), params("LR")).linear)


@query(_epochs_sql(3))
def ftrl_batch_epochs_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(train_batch(materialize(samples(spark, sf_dir), "samples"), params("LR", n_epochs=3)).linear)


#: Lines as samples: feature 0 is the quantity of each line, then come suppliers and parts.
_PART = 200_000
_LINES = f"""
k AS (SELECT row_number() OVER () AS event_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_suppkey::INTEGER AS s, {_PART} + l_partkey::INTEGER AS p, (l_quantity / 50.0)::FLOAT::DOUBLE AS x FROM lineitem),
e AS (SELECT event_id, y, -1 AS f, 1.0::DOUBLE AS x FROM k UNION ALL SELECT event_id, y, 0, x FROM k UNION ALL SELECT event_id, y, s, 1 FROM k UNION ALL SELECT event_id, y, p, 1 FROM k),
s0 AS (SELECT DISTINCT f, 0.0::DOUBLE AS n, 0.0::DOUBLE AS z, 0.0::DOUBLE AS w FROM e)"""


@query(f"WITH {_LINES}{_step_sql(0)}{_step_sql(1)} SELECT f::INTEGER AS feat, round(w, 7) AS w, round(n, 5) AS n, round(z, 5) AS z FROM s2")
def ftrl_bucketed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps over lines whose entries are written once, in buckets of features; the quantity is a feature of all of them, so it is split."""
    li = table(spark, sf_dir, "lineitem")
    entry = lambda field, feat, value: F.struct(F.lit(field).alias("field"), feat.cast("int").alias("feat"), value.cast("float").alias("value"))
    x = F.array(entry(0, F.lit(0), F.col("l_quantity") / 50.0), entry(1, F.col("l_suppkey"), F.lit(1.0)), entry(2, F.col("l_partkey") + _PART, F.lit(1.0)))
    given = li.select(F.monotonically_increasing_id().alias("seq"), (F.col("l_returnflag") == "R").cast("int").alias("y"), x.alias("x"))
    model = train_bucketed(materialize(given, "samples"), params("LR", n_epochs=2), buckets=16, most=50_000).linear
    return model.select("feat", F.round("w", 7).alias("w"), F.round("n", 5).alias("n"), F.round("z", 5).alias("z"))


def _vectors(gradients: DataFrame, *key: str) -> DataFrame:
    long = gradients.select(*key, F.posexplode(F.arrays_zip("g", "q")).alias("k", "s"))
    return long.select(*key, "k", F.round("s.g", 6).alias("g"), F.round("s.q", 6).alias("q"))


def _fm_gradient_sql() -> str:
    rows = []
    for k in range(K):
        total = f"({_v('a', k)} + {_v('b', k)} + {_v('c', k)} * x)"
        for f, x in (("a", "1"), ("b", "1"), ("c", "x")):
            rows.append(f"SELECT {f}::INTEGER AS feat, {k} AS k, err * ({x} * {total} - {_v(f, k)} * {x} * {x}) AS g, {x} <> 0 AS used FROM r")
    return f"WITH {D}, r AS (SELECT *, 1 / (1 + exp(-({FM}))) - y AS err FROM d) SELECT feat, k, round(sum(g), 6) AS g, round(sum(g * g), 6) AS q FROM ({' UNION ALL '.join(rows)}) GROUP BY feat, k"


def _scored(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Events scored by the weights of a rule, with their errors."""
    s, n = numbered_samples(spark, sf_dir)
    model = formula_model(spark, kind, n)
    return scored_rows(s, model.linear, model.factors, model.params).withColumn("e", sigmoid(F.col("logit")) - F.col("y"))


@query(_fm_gradient_sql())
def fm_batch_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(fm_gradients(_scored(spark, sf_dir, "FM"), K), "feat")


def _ffm_gradient_sql() -> str:
    rows = []
    for i, fi, j, fj, xx in (("a", 0, "b", 1, "1"), ("a", 0, "c", 2, "x"), ("b", 1, "c", 2, "x")):
        for k in range(K):
            rows.append(f"SELECT {i}::INTEGER AS feat, {fj} AS field, {k} AS k, err * {_vf(j, fi, k)} * {xx} AS g FROM r")
            rows.append(f"SELECT {j}::INTEGER, {fi}, {k}, err * {_vf(i, fj, k)} * {xx} FROM r")
    return f"WITH {D}, r AS (SELECT *, 1 / (1 + exp(-({FFM}))) - y AS err FROM d) SELECT feat, field, k, round(sum(g), 6) AS g, round(sum(g * g), 6) AS q FROM ({' UNION ALL '.join(rows)}) GROUP BY feat, field, k"


@query(_ffm_gradient_sql())
def ffm_batch_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(ffm_gradients(_scored(spark, sf_dir, "FFM"), K), "feat", "field")


def formula_start(spark: SparkSession, kind: str, n_feats: int, **more) -> Model:
    """A model to train on from: factors that a rule gives instead of hashes, sums that stand for them, no linear weights yet."""
    p = params(kind, factor_init="warm", **more)
    given = formula_model(spark, kind, n_feats)
    return Model(p, given.linear.limit(0), given.factors.withColumn("z", F.transform("v", lambda v: ftrl_z(v, p))))


_PROX = "(CASE WHEN abs({z}) <= 0.1 THEN 0 ELSE -({z} - (CASE WHEN {z} > 0 THEN 1 ELSE -1 END) * 0.1) / (5 + (1 + sqrt({n})) / 0.05) END)"


def _factor_steps_sql(kind: str, epochs: int) -> str:
    """Steps of an FM or FFM over all samples, unrolled: s0, s1 and so on for linear weights, v0, v1 and so on for factors, o0, o1 and so on for logits before the step."""
    ffm = kind == "FFM"
    start = " UNION ALL ".join(
        f"SELECT f, {g} AS g, {k} AS k, {_vf('f', g, k) if ffm else _v('f', k)} AS v FROM every" for g in (range(3) if ffm else (0,)) for k in range(K)
    )
    pairs = "SELECT event_id, a AS i, 0 AS fi, b AS j, 1 AS fj, 1.0::DOUBLE AS xx FROM d UNION ALL SELECT event_id, a, 0, c, 2, x FROM d UNION ALL SELECT event_id, b, 1, c, 2, x FROM d"
    sql = f"""WITH {D},
every AS (SELECT unnest(range(0, (SELECT c + 1 FROM m))) AS f),
e AS (SELECT event_id, a AS f, 1.0::DOUBLE AS x FROM d UNION ALL SELECT event_id, b, 1 FROM d UNION ALL SELECT event_id, c, x FROM d),
l AS (SELECT * FROM e UNION ALL SELECT event_id, -1, 1 FROM d),
p AS ({pairs}),
s0 AS (SELECT DISTINCT f, 0.0::DOUBLE AS n, 0.0::DOUBLE AS z, 0.0::DOUBLE AS w FROM l),
v0 AS (SELECT f, g, k, 0.0::DOUBLE AS n, -v * 25.0 - sign(v) * 0.1 AS z, v FROM ({start}))"""
    for i in range(epochs):
        if ffm:
            sql += f""",
j{i} AS (SELECT p.*, vi.k, vi.v AS vi, vj.v AS vj FROM p JOIN v{i} vi ON vi.f = i AND vi.g = fj JOIN v{i} vj ON vj.f = j AND vj.g = fi AND vj.k = vi.k),
c{i} AS (SELECT event_id, sum(vi * vj * xx) AS crossed FROM j{i} GROUP BY event_id),"""
        else:
            sql += f""",
j{i} AS (SELECT event_id, k, sum(v * x) AS t, sum(v * x * v * x) AS q FROM e JOIN v{i} USING (f) GROUP BY event_id, k),
c{i} AS (SELECT event_id, 0.5 * sum(t * t - q) AS crossed FROM j{i} GROUP BY event_id),"""
        sql += f"""
b{i} AS (SELECT event_id, sum(w * x) AS linear FROM l JOIN s{i} USING (f) GROUP BY event_id),
o{i} AS (SELECT event_id, y, linear + crossed AS logit, 1 / (1 + exp(-(linear + crossed))) - y AS err FROM d JOIN b{i} USING (event_id) JOIN c{i} USING (event_id)),
g{i} AS (SELECT f, sum(err * x) AS g, sum(err * x * err * x) AS q FROM l JOIN o{i} USING (event_id) GROUP BY f),
h{i} AS (SELECT f, n + q AS n, z + g - (sqrt(n + q) - sqrt(n)) / 0.05 * w AS z FROM s{i} JOIN g{i} USING (f)),
s{i + 1} AS (SELECT f, n, z, {_PROX.format(z="z", n="n")} AS w FROM h{i}),"""
        if ffm:
            each = f"SELECT i AS f, fj AS g, k, err * vj * xx AS d FROM j{i} JOIN o{i} USING (event_id) UNION ALL SELECT j, fi, k, err * vi * xx FROM j{i} JOIN o{i} USING (event_id)"
        else:
            each = f"SELECT f, 0 AS g, k, err * (x * t - v * x * x) AS d FROM e JOIN v{i} USING (f) JOIN j{i} USING (event_id, k) JOIN o{i} USING (event_id)"
        sql += f"""
u{i} AS (SELECT f, g, k, sum(d) AS d, sum(d * d) AS q FROM ({each}) GROUP BY f, g, k),
w{i} AS (SELECT f, g, k, n + coalesce(q, 0) AS n, z + coalesce(d, 0) - (sqrt(n + coalesce(q, 0)) - sqrt(n)) / 0.05 * v AS z FROM v{i} LEFT JOIN u{i} USING (f, g, k)),
v{i + 1} AS (SELECT f, g, k, n, z, {_PROX.format(z="z", n="n")} AS v FROM w{i})"""
    return sql


def _factor_rows(model: Model) -> DataFrame:
    long = model.factors.select(*model.factor_key, F.posexplode(F.arrays_zip("v", "n", "z")).alias("k", "s"))
    return long.select(*model.factor_key, "k", F.round("s.v", 7).alias("v"), F.round("s.n", 6).alias("n"), F.round("s.z", 6).alias("z"))


_FACTOR_ROWS = "k::INTEGER AS k, round(v, 7) AS v, round(n, 6) AS n, round(z, 6) AS z FROM v{n}"


def trained_factors(spark: SparkSession, sf_dir: str, kind: str, epochs: int = 2) -> tuple[DataFrame, Model]:
    s, n = numbered_samples(spark, sf_dir)
    s = materialize(s, "samples")
    start = formula_start(spark, kind, n, n_epochs=epochs)
    return s, train_batch(s, start.params, start)


@query(_factor_steps_sql("FM", 2) + " SELECT f::INTEGER AS feat, " + _FACTOR_ROWS.format(n=2))
def ftrl_batch_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _factor_rows(trained_factors(spark, sf_dir, "FM")[1])


@query(_factor_steps_sql("FFM", 2) + " SELECT f::INTEGER AS feat, g::INTEGER AS field, " + _FACTOR_ROWS.format(n=2))
def ftrl_batch_ffm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _factor_rows(trained_factors(spark, sf_dir, "FFM")[1])


@query(_factor_steps_sql("FM", 2) + " SELECT f::INTEGER AS feat, round(w, 8) AS w, round(n, 6) AS n, round(z, 6) AS z FROM s2")
def ftrl_batch_fm_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trained_factors(spark, sf_dir, "FM")[1].linear)


@query(_factor_steps_sql("FFM", 1) + " SELECT f::INTEGER AS feat, g::INTEGER AS field, " + _FACTOR_ROWS.format(n=1))
def ffm_model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trained FFM, saved and loaded."""
    path = scratch_path(spark, "saved")
    save_model(trained_factors(spark, sf_dir, "FFM", 1)[1], path)
    return _factor_rows(load_model(spark, path))


@query(_factor_steps_sql("FM", 1) + " SELECT f::INTEGER AS feat, k::INTEGER AS k, round(v, 7) AS v FROM v1")
def fm_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trained FM as text, and read again."""
    model, path = trained_factors(spark, sf_dir, "FM", 1)[1], scratch_path(spark, "text")
    export_text(model, path)
    return _factor_rows(import_text(spark, path, model.params)).select("feat", "k", "v")


#: Shards of the mixing queries: part of what they compute, so the same for every table. More data ask for more.
SHARDS = 16


def _mixing(spark: SparkSession, sf_dir: str, kind: str, init: str = "warm") -> DataFrame:
    """A row for each linear weight and, with v, vn and vz, for each factor."""
    s = materialize(samples(spark, sf_dir), "samples")
    model, losses = mixing_round(s, empty_model(spark, params(kind, factor_init=init)), SHARDS)
    rows = model.linear
    if model.factors is not None:
        rows = rows.unionByName(model.factors.select(*model.factor_key, "v", F.col("n").alias("vn"), F.col("z").alias("vz")), allowMissingColumns=True)
    return rows.crossJoin(F.broadcast(losses.select("loss")))  # one row


@query()
def ftrl_mixing_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing(spark, sf_dir, "LR")


@query()
def ftrl_mixing_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing(spark, sf_dir, "FM")


@query()
def ftrl_mixing_ffm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing(spark, sf_dir, "FFM")


#: The feature of a document's share, or the one after all words where these reach it.
SHARE = (1 << 20) - 1


def document_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples: whether they are long, by language, source and a share of their id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    words = materialize(enc.dictionaries(d, ["lang", "source"]), "words")
    first = max(SHARE, (words.agg(F.max("feat")).first()[0] or 0) + 1)
    share = d.withColumn("share", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(97)) / 97.0)
    return enc.encode(share, words, first, ["lang", "source"], ["share"], (F.col("n_chars") > 2000).cast("int"), "doc_id").filter(F.col("seq").isNotNull() & F.col("y").isNotNull())


def _mixing_documents(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The mixing plan over a table that grows; shards follow its rows, so that a task's work does not."""
    s = materialize(document_samples(spark, sf_dir), "samples")
    model, losses = mixing_round(s, empty_model(spark, params(kind, factor_init="warm")), max(SHARDS, -(-s.count() // 4096)))
    return model.factors.select(*model.factor_key, "v", "n", "z").crossJoin(F.broadcast(losses.select("loss")))  # one row


@query()
def ftrl_mixing_fm_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing_documents(spark, sf_dir, "FM")


@query()
def ftrl_mixing_ffm_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing_documents(spark, sf_dir, "FFM")


_STATE = "CASE WHEN k = 1 OR k = f THEN {new} ELSE {old} END"


_SEQUENTIAL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS i, CASE WHEN s_acctbal > 4000 THEN 1 ELSE 0 END AS y, s_nationkey::INTEGER + 2 AS f FROM supplier),
r AS (
  SELECT 0::BIGINT AS i, list_transform(range(1, 40), lambda k: 0.0::DOUBLE) AS n, list_transform(range(1, 40), lambda k: 0.0::DOUBLE) AS z, list_transform(range(1, 40), lambda k: 0) AS met, 0.0::DOUBLE AS loss
  UNION ALL
  SELECT i, list_transform(range(1, 40), lambda k: {_STATE.format(new="n[k] + e * e", old="n[k]")}),
    list_transform(range(1, 40), lambda k: {_STATE.format(new="z[k] + e - (sqrt(n[k] + e * e) - sqrt(n[k])) / 0.05 * CASE WHEN k = 1 THEN wb ELSE wf END", old="z[k]")}),
    list_transform(range(1, 40), lambda k: {_STATE.format(new="1", old="met[k]")}), loss + CASE WHEN y = 1 THEN ln(1 + exp(-(wb + wf))) ELSE ln(1 + exp(wb + wf)) END
  FROM (SELECT *, 1 / (1 + exp(-(wb + wf))) - y AS e FROM (
    SELECT d.i, n, z, met, loss, d.f, d.y, {_PROX.format(z="z[1]", n="n[1]")} AS wb, {_PROX.format(z="z[d.f]", n="n[d.f]")} AS wf FROM r JOIN d ON d.i = r.i + 1)))
SELECT k::INTEGER - 2 AS feat, round(n[k], 3) AS n, round(z[k], 3) AS z, round(loss / i, 3) AS loss FROM (SELECT *, unnest(range(1, 40)) AS k FROM r WHERE i = (SELECT count(*) FROM supplier)) WHERE met[k] = 1"""


@query(_SEQUENTIAL)
def ftrl_sequential_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers one after another in one shard: the plain sequential algorithm."""
    supplier = table(spark, sf_dir, "supplier")
    x = F.array(F.struct(F.lit(0).alias("field"), F.col("s_nationkey").cast("int").alias("feat"), F.lit(1.0).cast("float").alias("value")))
    given = supplier.select(F.col("s_suppkey").alias("seq"), (F.col("s_acctbal") > 4000).cast("int").alias("y"), x.alias("x"))
    model, losses = mixing_round(given, empty_model(spark, params("LR")), 1)
    rows = model.linear.select("feat", F.round("n", 3).alias("n"), F.round("z", 3).alias("z"))
    return rows.crossJoin(F.broadcast(losses.select(F.round("loss", 3).alias("loss"))))  # one row


@query(_SEQUENTIAL)
def stream_fold_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as lines of files, in order, that are read as a stream of three batches; a shard keeps its state over them."""
    path, log, state, out = (scratch_path(spark, x) for x in ("file", "log", "state", "fold"))
    y = (F.col("s_acctbal") > 4000).cast("int")
    text = table(spark, sf_dir, "supplier").select("s_suppkey", F.format_string("%d %d:1", y, F.col("s_nationkey").cast("int")).alias("value"))
    write_lines(text.orderBy("s_suppkey"), path)
    size = text.agg(F.sum(F.length("value") + 1)).first()[0] or 1
    losses = fold_stream(bounded_lines(spark, path, log, -(-size // 3)), params("LR"), "libsvm", 1, state, out)
    rows = folded_model(spark, params("LR"), state).linear.select("feat", F.round("n", 3).alias("n"), F.round("z", 3).alias("z"))
    return rows.crossJoin(F.broadcast(losses.agg(F.round(F.sum("loss") / F.sum("rows"), 3).alias("loss"))))  # one row


ARRIVALS = 3
#: The number as it comes back from text of four decimals.
_WRITTEN = "round_even(x, 4)::FLOAT::DOUBLE"


#: Events that are evaluated on, not trained on, where a query has both.
HELD = "event_id % 4 = 1"


def _arrivals(spark: SparkSession, given: DataFrame, which: str = "TRUE", parts: int = ARRIVALS) -> str:
    """Samples of a condition as text files that arrive one after another: a folder, each file written after the one before."""
    path = scratch_path(spark, "lines")
    text = materialize(enc.lines(given, "libffm").filter(which.replace("event_id", "seq")), "text")
    for i in range(parts):
        text.filter(F.col("seq") % parts == i).select("value").repartition(1).write.mode("append").text(path)
    return path


def _stream_sql(passes: int, which: str = "TRUE") -> str:
    """LR steps over arrivals, unrolled."""
    sql = _steps_head(_WRITTEN)
    for i in range(passes * ARRIVALS):
        sql += _step_sql(i, f"event_id % {ARRIVALS} = {i % ARRIVALS} AND {which}")
    return sql


_FILE_LINE = _line(("0:", "a"), ("1:", "b")).split(" SELECT ", 1)[1].replace(" AS seq", "") + f"|| '2:' || c || ':' || {QUARTER} AS value FROM d"


def _bounded_sql() -> str:
    """LR steps over the bytes of one file, a third of them each: a line is of the step that its first byte is of."""
    sql = _steps_head("floor(x * 4) / 4") + f""",
t0 AS (SELECT event_id, sum(length(value) + 1) OVER (ORDER BY event_id) - length(value) - 1 AS place, sum(length(value) + 1) OVER () AS size FROM (SELECT {_FILE_LINE})),
b AS (SELECT event_id, place::BIGINT // ceil(size / {ARRIVALS}.0)::BIGINT AS batch FROM t0)"""
    for i in range(ARRIVALS):
        sql += _step_sql(i, f"event_id IN (SELECT event_id FROM b WHERE batch = {i})")
    return sql + f" SELECT f::INTEGER AS feat, round(w, 7) AS w, round(n, 6) AS n, round(z, 6) AS z FROM s{ARRIVALS}"


@query(_bounded_sql())
def stream_train_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text files, in order, trained on as a stream of three batches: so many bytes each, wherever files end."""
    path, log, offsets, models = (scratch_path(spark, x) for x in ("file", "log", "offsets", "online"))
    text = materialize(enc.lines(quarter_samples(spark, sf_dir), "libffm"), "text")
    write_lines(text.orderBy("seq"), path)
    size = text.agg(F.sum(F.length("value") + 1)).first()[0] or 1
    train_stream(bounded_lines(spark, path, log, -(-size // ARRIVALS)), params("LR"), "libffm", offsets, models)
    model = latest_model(spark, models, params("LR")).linear
    return model.select("feat", F.round("w", 7).alias("w"), F.round("n", 6).alias("n"), F.round("z", 6).alias("z"))


@query(_stream_sql(1) + f" SELECT f::INTEGER AS feat, round(w, 6) AS w, round(n, 5) AS n, round(z, 5) AS z FROM s{ARRIVALS}")
def stream_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text files, trained on as a stream, a file to a micro-batch."""
    models, p = scratch_path(spark, "online"), params("LR")
    train_stream(stream_lines(spark, _arrivals(spark, samples(spark, sf_dir)), 1), p, "libffm", scratch_path(spark, "offsets"), models)
    model = latest_model(spark, models, p).linear
    return model.select("feat", F.round("w", 6).alias("w"), F.round("n", 5).alias("n"), F.round("z", 5).alias("z"))


_EPOCH_LOSS = "SELECT {e} AS epoch, round((SELECT avg(" + LOSS + ") FROM ({train})), 6) AS train_loss, round((SELECT avg(" + LOSS + ") FROM ({held})), 6) AS eval_loss"


def _epochs(spark: SparkSession, epochs: list) -> DataFrame:
    return spark.createDataFrame([(i, round(e.train_loss, 6), round(e.eval_loss, 6)) for i, e in enumerate(epochs)], "epoch int, train_loss double, eval_loss double")


def _task_params(**more) -> Params:
    """Of a linear model whose unseen features have weight 0, so that SQL can score them."""
    return replace(params("LR"), init_stddev=0.0, **more)


def _online_sql(passes: int) -> str:
    sql = _stream_sql(passes, f"NOT ({HELD})")
    steps = passes * ARRIVALS
    for i in range(ARRIVALS, steps + 1, ARRIVALS):
        sql += _logit_sql(f"t{i}", f"s{i}", HELD)
    rows = [_EPOCH_LOSS.format(e=e, train=" UNION ALL ".join(f"SELECT y, logit FROM r{i}" for i in range(e * ARRIVALS, (e + 1) * ARRIVALS)), held=f"SELECT y, logit FROM t{(e + 1) * ARRIVALS}") for e in range(passes)]
    return sql + " " + " UNION ALL ".join(rows)


def _both_paths(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    given = samples(spark, sf_dir)
    return {"train_data": _arrivals(spark, given, f"NOT ({HELD})"), "eval_data": _arrivals(spark, given, HELD, 1)}


@query(_online_sql(2))
def online_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over arriving files and an evaluation on held-out ones after each: losses of the passes."""
    return _epochs(spark, run_task(spark, _task_params(n_epochs=2, **_both_paths(spark, sf_dir)))[1])


def _offline_sql(passes: int) -> str:
    sql = _steps_head(_WRITTEN) + "".join(_step_sql(i, f"NOT ({HELD})") for i in range(passes))
    for i in range(1, passes + 1):
        sql += _logit_sql(f"t{i}", f"s{i}", HELD)
    return sql + " " + " UNION ALL ".join(_EPOCH_LOSS.format(e=e, train=f"SELECT y, logit FROM r{e}", held=f"SELECT y, logit FROM t{e + 1}") for e in range(passes))


@query(_offline_sql(2))
def offline_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs over text files and an evaluation on held-out ones after each: losses of the epochs."""
    return _epochs(spark, run_task(spark, _task_params(online=False, n_epochs=2, **_both_paths(spark, sf_dir)))[1])


@query(_offline_sql(2))
def offline_task_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task of one epoch, and the same one again with a second epoch: it goes on from what it finds."""
    both, work = _both_paths(spark, sf_dir), scratch_path(spark, "work")
    for n in (1, 2):
        epochs = run_task(spark, _task_params(online=False, n_epochs=n, work_path=work, **both))[1]
    return _epochs(spark, epochs)


@query(_stream_sql(1) + f" SELECT f::INTEGER AS feat, round(w, 6) AS w, round(n, 5) AS n, round(z, 5) AS z FROM s{ARRIVALS}")
def stream_train_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the first arrivals, stopped, and another one over the same folder once the others are there."""
    path, offsets, models = (scratch_path(spark, x) for x in ("lines", "offsets", "online"))
    text = materialize(enc.lines(samples(spark, sf_dir), "libffm"), "text")
    for i in range(ARRIVALS):
        text.filter(F.col("seq") % ARRIVALS == i).select("value").repartition(1).write.mode("append").text(path)
        if i:
            train_stream(stream_lines(spark, path, 1), params("LR"), "libffm", offsets, models)
    model = latest_model(spark, models, params("LR")).linear
    return model.select("feat", F.round("w", 6).alias("w"), F.round("n", 5).alias("n"), F.round("z", 5).alias("z"))


# samples


@query(f"WITH {D} SELECT y AS given, 1 AS copies, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT 2, 3, 3 * count(*) FROM d")
def negative_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives for each event: how many rows there are, of each label, all drawn numbers within their fields."""
    s = materialize(samples(spark, sf_dir), "samples")
    laid = enc.offsets(enc.dictionaries(events(spark, sf_dir), CAT), 2).collect()
    sizes = [(int(r["start"]), int(r["cardinality"])) for r in sorted(laid, key=lambda r: r["field"])]
    both = enc.with_negatives(s.withColumn("given", F.col("y")).select("seq", "y", "x"), sizes, [(0.0, 1.0, False)], 3, 42)
    drawn = both.join(s.select("seq", F.lit(True).alias("own")), "seq", "left")
    inside: Column = F.lit(True)
    for i, (start, size) in enumerate(sizes):
        inside = inside & F.col("x")[i].feat.between(start, start + size - 1)
    given = F.when(F.col("own"), F.col("y")).otherwise(2)
    return drawn.filter(inside).groupBy(given.alias("given"), F.when(F.col("own"), 1).otherwise(3).alias("copies")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, row_number() OVER (ORDER BY {DRAW}, event_id) <= round(0.8 * (SELECT count(*) FROM events)) AS train FROM {hashed('events', ('int', '42'), ('long', 'event_id'))}")
def train_eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly the share of the rows that is asked for, drawn by the key."""
    train, evaluation = split(events(spark, sf_dir), 0.8, 42, "event_id")
    return train.select("event_id", F.lit(True).alias("train")).union(evaluation.select("event_id", F.lit(False)))


@query(f"SELECT event_id, event_type, user_id, value, row_number() OVER (ORDER BY {SIGNED}, event_id) - 1 AS place FROM {hashed('events', ('int', '42'), ('long', 'event_id'))}")
def shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled rows with their places."""
    return with_positions(events(spark, sf_dir), *enc.shuffled_by(42, "event_id"), name="place")


@query(_epochs_sql(1))
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, path = train_batch(materialize(samples(spark, sf_dir), "samples"), params("LR")), scratch_path(spark, "saved")
    save_model(model, path)
    return _rounded(load_model(spark, path).linear)


@query(_factor_steps_sql("FM", 1) + " SELECT (SELECT bool_or(w = 0) FROM s1 WHERE f >= 0) OR (SELECT bool_or(v = 0) FROM v1) AS has_zero, (SELECT count(*) FROM s1 WHERE f >= 0 AND w = 0) AS zero_weights, (SELECT count(*) FROM v1 WHERE v = 0) AS zero_factors")
def trained_zero_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether training has set weights or factors to exactly 0, and how many."""
    model = trained_factors(spark, sf_dir, "FM", 1)[1]
    weights = model.linear.filter("feat >= 0").agg(F.count_if(F.col("w") == 0).alias("zero_weights"))
    factors = model.factors.select(F.explode("v").alias("v")).agg(F.count_if(F.col("v") == 0).alias("zero_factors"))
    return zero_weights(model).crossJoin(F.broadcast(weights)).crossJoin(F.broadcast(factors))  # one row each


@query(_factor_steps_sql("FM", 2) + f" SELECT y, round(avg({LOSS}), 6) AS loss, count(*) AS n FROM o1 GROUP BY y")
def train_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses before the second step, by label."""
    s, model = trained_factors(spark, sf_dir, "FM", 1)
    _, losses = batch_step(s, model)
    return losses.groupBy("y").agg(F.round(F.avg("loss"), 6).alias("loss"), F.count(F.lit(1)).alias("n"))


# text in other forms


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of events, some entries of which no strict reader takes."""
    y = (F.col("value") > THRESHOLD).cast("int")
    return events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.concat_ws(" ", y, F.format_string("0:%d:1.5", "event_id"), F.lit("junk"), F.format_string("1:%d:-2", "user_id"), F.lit("2:7:x")).alias("value"))


def _entries(parsed: DataFrame) -> DataFrame:
    return parsed.select("seq", "y", F.posexplode("x").alias("pos", "e")).select("seq", "y", "pos", "e.field", "e.feat", F.col("e.value").cast("double").alias("value"))


_Y = f"CASE WHEN value > {THRESHOLD} THEN 1 ELSE 0 END AS y"


@query(f"SELECT event_id AS seq, {_Y}, 0 AS pos, 0 AS field, event_id::INTEGER AS feat, 1.5::DOUBLE AS value FROM events")
def parse_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(parse_by_pattern(_text(spark, sf_dir)))


@query(f"""SELECT event_id AS seq, {_Y}, 0 AS pos, 0 AS field, event_id::INTEGER AS feat, 1.5::DOUBLE AS value FROM events
UNION ALL SELECT event_id, {_Y}, 1, 0, 1, user_id::DOUBLE FROM events WHERE user_id <> 0 UNION ALL SELECT event_id, {_Y}, CASE WHEN user_id = 0 THEN 1 ELSE 2 END, -2, 2, 7 FROM events""")
def parse_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are no numbers count as 0, and triples go on after them."""
    return _entries(parse_garbage_as_zero(_text(spark, sf_dir)))


def _modes_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("event_id") % 7 == 0, " 5").when(F.col("event_id") % 7 == 1, " 1:x:2").otherwise("")
    y = (F.col("value") > THRESHOLD).cast("int")
    return events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.concat(y, F.format_string(" 0:%d:1", "user_id"), bad).alias("value"))


@query(f"SELECT event_id AS seq, {_Y}, user_id::INTEGER AS feat FROM events WHERE event_id % 7 > 1")
def parse_drop_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_samples(_modes_text(spark, sf_dir), "libffm", "DROPMALFORMED").select("seq", "y", F.col("x")[0].feat.alias("feat"))


@query(f"""SELECT event_id AS seq, CASE WHEN event_id % 7 > 1 THEN y ELSE -1 END AS y,
CASE event_id % 7 WHEN 0 THEN y || ' 0:' || user_id || ':1 5' WHEN 1 THEN y || ' 0:' || user_id || ':1 1:x:2' ELSE '' END AS corrupt FROM (SELECT event_id, user_id, {_Y} FROM events)""")
def parse_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_samples(_modes_text(spark, sf_dir), "libffm", "PERMISSIVE").select("seq", F.coalesce("y", F.lit(-1)).alias("y"), F.coalesce("_corrupt_record", F.lit("")).alias("corrupt"))


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, event_id || ' ' || event_type AS value FROM events")
def text_files_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written to several files in order, and numbered as they are read."""
    path = scratch_path(spark, "ordered")
    write_lines(events(spark, sf_dir).orderBy("event_id").select(F.concat_ws(" ", "event_id", "event_type").alias("value")), path)
    return read_lines(spark, path)


@query(r"""WITH q AS (SELECT event_id, event_id % 100000 AS q FROM events)
SELECT event_id, regexp_replace(printf('%.4f', (q // 10 + CASE WHEN q % 10 > 5 OR (q % 10 = 5 AND (q // 10) % 2 = 1) THEN 1 ELSE 0 END) / 10000), '(\.\d+?)0+$', '\1') AS text FROM q""")
def number_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five decimals as text of four, ties to even."""
    return events(spark, sf_dir).select("event_id", number_text((F.col("event_id") % 100000) / 100000.0).alias("text"))


# tables


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, o_custkey FROM orders),
s AS (SELECT v, row_number() OVER (ORDER BY v) AS f FROM (SELECT DISTINCT o_orderpriority AS v FROM o WHERE o_orderkey % 10 < 8)),
k AS (SELECT v, (SELECT count(*) FROM s) + row_number() OVER (ORDER BY v) AS f FROM (SELECT DISTINCT o_custkey AS v FROM o WHERE o_orderkey % 10 < 8)),
m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (SELECT count(*) FROM s) + (SELECT count(*) FROM k) + 1 AS c FROM o WHERE o_orderkey % 10 < 8)
SELECT o_orderkey AS seq, o_orderkey % 10 < 8 AS train, CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS y, coalesce(s.f, 0)::INTEGER AS priority, coalesce(k.f, 0)::INTEGER AS customer,
       c::INTEGER AS price_feat, round(((o_totalprice - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END)::FLOAT::DOUBLE, 5) AS price
FROM o LEFT JOIN s ON o_orderpriority = s.v LEFT JOIN k ON o_custkey = k.v CROSS JOIN m""")
def csv_to_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and eval rows as two CSV files with headers, read and encoded by the positions of columns."""
    paths = []
    for i, which in enumerate(("o_orderkey % 10 < 8", "o_orderkey % 10 >= 8")):
        paths.append(scratch_path(spark, f"csv{i}"))
        chosen = table(spark, sf_dir, "orders").filter(which)
        chosen.select("o_orderkey", "o_totalprice", "o_orderpriority", F.col("o_totalprice").alias("price"), "o_custkey").write.csv(paths[-1], header=True)
    p = EncodeParams(label_col=0, cat_cols=(1, 3), num_cols=(2,), threshold=150000, normalize=True)
    train, held = read_train_eval(spark, p, "", *paths)
    parts = []
    for which, (df, given) in zip((True, False), zip(enc.transform(train, held, p, "o_orderkey"), (train, held))):
        parts.append(df.select("seq", F.lit(which).alias("train"), "y", F.col("x")[0].feat.alias("priority"), F.col("x")[1].feat.alias("customer"), F.col("x")[2].feat.alias("price_feat"), F.round(F.col("x")[2].value.cast("double"), 5).alias("price")))
    return parts[0].union(parts[1])


_KEYED = "(SELECT l_orderkey::BIGINT * 8 + l_linenumber AS seq, l_quantity::INTEGER AS q, unnest([1, 2]) AS copy FROM lineitem)"


@query(f"""WITH b AS (SELECT min(l_quantity::INTEGER) AS lo, max(l_quantity::INTEGER) AS hi FROM lineitem)
SELECT (lo + floor({UNIFORM} * (hi - lo + 1)))::INTEGER AS drawn, count(*) AS n FROM {hashed(_KEYED, ("int", "42"), ("long", "seq"), ("int", "copy"), ("int", "0"))} CROSS JOIN b GROUP BY ALL""")
def whole_number_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two negatives for each line, its quantity drawn from the whole numbers between the table's smallest and largest one: how often each was drawn."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").cast("int").alias("q"))
    low = enc.bounds(li, ["q"]).first()
    x = F.array(F.struct(F.lit(0).alias("field"), F.lit(1).alias("feat"), F.col("q").cast("float").alias("value")))
    both = enc.with_negatives(li.select("seq", F.lit(1).alias("y"), x.alias("x")), [], [(float(low["min_q"]), float(low["max_q"]), True)], 2, 42)
    drawn = both.filter("y = 0").select(F.col("x")[0].value.cast("int").alias("drawn"))
    return drawn.groupBy("drawn").agg(F.count(F.lit(1)).alias("n"))


def _normal_sql(table_: str, seed: int, mean: float, *columns: tuple[str, str]) -> str:
    """Columns key, k and w (deviation 0.05) of a table of key and k."""
    u = f"(SELECT key, k, {UNIFORM} AS u FROM {hashed(table_, ('int', str(2 * seed)), *columns)})"
    v = f"(SELECT key, k, {UNIFORM} AS v FROM {hashed(table_, ('int', str(2 * seed + 1)), *columns)})"
    return f"SELECT key, k, {mean} + 0.05 * sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v) AS w FROM {u} JOIN {v} USING (key, k)"


def _gaussian_sql(table_: str, seed: int, *columns: tuple[str, str]) -> str:
    return f"SELECT key, k, round(w, 9) AS w FROM ({_normal_sql(table_, seed, 0.5, *columns)})"


@query(_gaussian_sql("(SELECT DISTINCT user_id::INTEGER AS key, -1 AS k FROM events)", 42, ("int", "key")) + " UNION ALL " + _gaussian_sql("(SELECT event_id::INTEGER AS key, unnest([0, 1, 2, 3]) AS k FROM events)", 43, ("int", "key"), ("int", "k")))
def initial_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initial weights of users (k = -1) and factors of events."""
    p = params("FM", init_mean=0.5)
    e = events(spark, sf_dir)
    weights = e.select(F.col("user_id").cast("int").alias("key")).distinct().select("key", F.lit(-1).alias("k"), initial_weight(p, F.col("key")).alias("w"))
    factors = e.select(F.col("event_id").cast("int").alias("key")).select("key", F.posexplode(initial_factors(p, F.col("key"))).alias("k", "w"))
    return weights.union(factors).select("key", "k", F.round("w", 9).alias("w"))


@query(f"""WITH {D}, f AS (SELECT a AS feat FROM d UNION SELECT b FROM d UNION SELECT c FROM d),
g AS ({_normal_sql("(SELECT feat::INTEGER AS key, 0 AS k FROM f)", 42, 0.02, ("int", "key"))}),
w AS (SELECT feat, CASE WHEN feat % 4 = 3 THEN g.w WHEN feat * 37 % 101 < 70 THEN 0 ELSE {_w("feat")} END AS w FROM f JOIN g ON g.key = feat)
SELECT event_id AS seq, y, round(0.1::DOUBLE + p.w + q.w + r.w * x, 8) AS logit FROM d JOIN w p ON p.feat = a JOIN w q ON q.feat = b JOIN w r ON r.feat = c""")
def sparse_linear_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a model most of whose touched weights are 0 and a quarter of whose features were never touched."""
    given, n = numbered_samples(spark, sf_dir)
    linear = formula_model(spark, "LR", n).linear.filter("feat < 0 OR feat % 4 != 3")
    w = F.when((F.col("feat") >= 0) & (F.pmod(F.col("feat") * 37, F.lit(101)) < 70), 0.0).otherwise(F.col("w"))
    model = sparse_linear(Model(replace(params(init_mean=0.02), n_feats=n), linear.withColumn("w", w)))
    return sparse_logits(given, model).select("seq", "y", F.round("logit", 8).alias("logit"))
