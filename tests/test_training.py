import math

import pytest
from pyspark.sql import functions as F

from sparseloom.functions.metrics import mean_loss
from sparseloom.functions.params import Params
from sparseloom.operators.model import dense_linear, empty_model, export_text, import_text, load_model, save_model, zero_weights
from sparseloom.operators.score import logits
from sparseloom.plans.batch import batch_step, train_batch
from sparseloom.plans.mixing import Fold, mixing_round, train_mixing
from sparseloom.plans.tasks import evaluate, run

#: Ten rows of four fields, all of value 1: label and the features of fields 0 to 3.
ROWS = [
    (0, (1, 13, 21, 31)), (1, (4, 11, 23, 32)), (1, (2, 13, 25, 34)), (0, (1, 14, 21, 32)), (0, (2, 15, 22, 34)),
    (1, (4, 11, 21, 35)), (1, (5, 12, 23, 31)), (1, (5, 12, 25, 38)), (0, (2, 11, 24, 37)), (1, (1, 15, 22, 35)),
]
LINES = [f"{y} " + " ".join(f"{i}:{f}:1" for i, f in enumerate(x)) for y, x in ROWS]


def params(kind, **more):
    return Params(**({"model_type": kind, "n_fields": 4, "n_feats": 50, "n_factors": 4, "w_alpha": 0.1} | more))


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(i, y, [(k, f, 1.0) for k, f in enumerate(x)]) for i, (y, x) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "seq long, y int, x array<struct<field: int, feat: int, value: float>>").cache()


@pytest.mark.parametrize("kind", ["LR", "FM", "FFM"])
@pytest.mark.parametrize("alpha,want", [(1e-4, 0.692075), (0.1, 0.289300)])
def test_sequential_losses(kind, alpha, want):
    """In parity mode factors stay 0, so all models learn as the linear one does."""
    fold, loss = Fold(params(kind, w_alpha=alpha)), 0.0
    for _ in range(50):
        loss = sum(fold.learn(y, [(i, f, 1.0) for i, f in enumerate(x)]) for y, x in ROWS) / 10
    assert loss == pytest.approx(want, abs=2e-6)
    assert all((s == 0).all() for s in fold.factors.values())


@pytest.mark.parametrize("kind", ["FM", "FFM"])
def test_warm_factors_learn_more(kind):
    fold, loss = Fold(params(kind, factor_init="warm")), 0.0
    for _ in range(50):
        loss = sum(fold.learn(y, [(i, f, 1.0) for i, f in enumerate(x)]) for y, x in ROWS) / 10
    assert loss < 0.285 and math.isfinite(loss)


def test_repeated_feature_in_a_row():
    fold = Fold(params("FFM", factor_init="warm"))
    assert math.isfinite(fold.learn(1, [(0, 0, 1.0), (1, 0, 1.0), (1, 0, 0.5)]))


def test_one_shard_is_the_sequential_algorithm(spark, samples):
    model, losses = mixing_round(samples, empty_model(spark, params("LR")), shards=1, epochs=50)
    assert losses.first()["loss"] == pytest.approx(0.2893, abs=2e-6)
    fold = Fold(params("LR"))
    for _ in range(50):
        for y, x in ROWS:
            fold.learn(y, [(i, f, 1.0) for i, f in enumerate(x)])
    got = {r["feat"]: (r["w"], r["n"], r["z"]) for r in model.linear.collect()}
    assert got.keys() == fold.linear.keys()
    for f, s in fold.linear.items():
        assert got[f] == pytest.approx(tuple(map(float, s)), rel=1e-6)


def test_epochs_take_samples_in_other_orders(spark, samples):
    p = params("LR", n_epochs=3)
    model, again = (sorted(map(tuple, train_mixing(samples.repartition(k), p, shards=1).linear.collect())) for k in (1, 3))
    assert model == again
    in_file_order = empty_model(spark, p)
    for _ in range(3):
        in_file_order = mixing_round(samples, in_file_order, 1)[0]
    assert model != sorted(map(tuple, in_file_order.linear.collect()))


def test_shards_are_averaged(spark, samples):
    model = train_mixing(samples, params("FFM", n_epochs=2, factor_init="warm"), shards=3)
    assert model.linear.filter("feat = -1").count() == 1
    assert model.factors.filter(F.size("v") == 4).count() == model.factors.count() > 0


@pytest.mark.parametrize("kind", ["LR", "FM", "FFM"])
def test_batch_training_lowers_the_loss(spark, samples, kind):
    p = params(kind, n_epochs=3, factor_init="warm")
    model = train_batch(samples, p)
    assert evaluate(samples, model) < evaluate(samples, train_batch(samples, params(kind, n_epochs=1, factor_init="warm"))) < math.log(2)
    again = train_batch(samples.repartition(7), p)
    a, b = (sorted((r["feat"], round(r["w"], 9)) for r in m.linear.collect()) for m in (model, again))
    assert a == b


def test_parity_models_are_equal(spark, samples):
    w = [sorted((r["feat"], round(r["w"], 9)) for r in train_batch(samples, params(k)).linear.collect()) for k in ("LR", "FM", "FFM")]
    assert w[0] == w[1] == w[2]


def test_batch_step_by_hand(spark):
    df = spark.createDataFrame([(0, 1, [(0, 3, 2.0)]), (1, 0, [(0, 3, 1.0), (0, 3, 1.0)])], "seq long, y int, x array<struct<field: int, feat: int, value: float>>")
    model, losses = batch_step(df, empty_model(spark, params("LR")))
    got = {r["feat"]: (r["n"], r["z"]) for r in model.linear.collect()}
    # errors -0.5 and 0.5: gradients -1 for the first row, 0.5 twice for the second
    assert got[3] == pytest.approx((1.5, 0.0)) and got[-1] == pytest.approx((0.5, 0.0))
    assert mean_loss(losses).first()["loss"] == pytest.approx(math.log(2))


def test_rows_without_entries(spark):
    df = spark.createDataFrame([(0, 1, []), (1, 0, [(0, 99, 1.0)])], "seq long, y int, x array<struct<field: int, feat: int, value: float>>")
    model = train_batch(df, params("FM"))
    assert [r["feat"] for r in model.linear.collect()] == [-1]
    assert logits(df, model).count() == 2
    assert train_batch(df.limit(0), params("LR")).linear.count() == 0


@pytest.mark.parametrize("kind", ["LR", "FM", "FFM"])
def test_saved_models(spark, samples, kind, tmp_path):
    p = params(kind, factor_init="warm", n_epochs=2)
    model = train_batch(samples, p)
    save_model(model, str(tmp_path / "m"))
    export_text(model, str(tmp_path / "t"))
    want = {r["seq"]: r["logit"] for r in logits(samples, model).collect()}
    loaded = load_model(spark, str(tmp_path / "m"))
    assert loaded.params == p
    for other in (loaded, import_text(spark, str(tmp_path / "t"), p)):
        assert {r["seq"]: r["logit"] for r in logits(samples, other).collect()} == pytest.approx(want)
    on = train_batch(samples, p, loaded)  # training goes on from the sums that were saved
    assert evaluate(samples, on) < evaluate(samples, model)


def test_zero_weights_and_initial_ones(spark, samples):
    model = train_batch(samples, params("FM"))
    assert zero_weights(model).first()[0] is True
    dense = {r["feat"]: r["w"] for r in dense_linear(model).collect()}
    assert len(dense) == 51 and dense[49] != 0 and abs(dense[49]) < 0.2


@pytest.mark.parametrize("online", [True, False])
def test_tasks(spark, tmp_path, online):
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "a.txt").write_text("\n".join(LINES[:5]))
    (tmp_path / "train" / "b.txt").write_text("\n".join(LINES[5:]))
    p = params("FFM", online=online, n_epochs=2, train_data=str(tmp_path / "train"), eval_data=str(tmp_path / "train"), model_path=str(tmp_path / "model"))
    model, epochs = run(spark, p)
    assert len(epochs) == 2 and epochs[-1].eval_loss < epochs[0].eval_loss < math.log(2) and epochs[1].train_loss < epochs[0].train_loss
    assert evaluate(spark.createDataFrame([(i, y, [(k, f, 1.0) for k, f in enumerate(x)]) for i, (y, x) in enumerate(ROWS)], "seq long, y int, x array<struct<field: int, feat: int, value: float>>"), load_model(spark, p.model_path)) == pytest.approx(epochs[-1].eval_loss)


def test_sequential_equals_batch_for_one_sample(spark, samples):
    one = samples.filter("seq = 0")
    a = {r["feat"]: r["z"] for r in train_batch(one, params("LR")).linear.collect()}
    b = {r["feat"]: r["z"] for r in mixing_round(one, empty_model(spark, params("LR")), 1)[0].linear.collect()}
    assert a == pytest.approx(b)


@pytest.mark.parametrize("kind", ["FM", "FFM"])
def test_mixing_queries_have_averaged_factors(spark, small, kind):
    """Factors of the query are the averages over shards that were folded by hand; the kept model doesn't fold again."""
    from sparseloom import queries

    p, s = queries.params(kind, factor_init="warm"), queries.samples(spark, small)
    n = queries.SHARDS
    folds = [Fold(p) for _ in range(n)]
    for r in s.withColumn("shard", F.pmod(F.xxhash64("seq"), F.lit(n))).orderBy("seq").collect():
        folds[r["shard"]].learn(r["y"], [(e["field"], e["feat"], e["value"]) for e in r["x"]])
    want = {}
    for fold in folds:
        for key, state in fold.factors.items():
            want.setdefault(key, []).append(state)
    rows = queries.QUERIES[f"ftrl_mixing_{kind.lower()}"](spark, small).collect()
    got = {(r["feat"], r["field"]) if kind == "FFM" else (r["feat"],): r for r in rows if r["w"] is None}
    assert got.keys() == want.keys() and any(len(states) > 1 for states in want.values())
    for key, states in want.items():
        for i, c in enumerate(("v", "vn", "vz")):
            assert got[key][c] == pytest.approx([sum(map(float, x)) / len(states) for x in zip(*(t[i] for t in states))], rel=1e-4, abs=1e-6)
    assert len([r for r in rows if r["w"] is not None]) == len(set().union(*(f.linear for f in folds)))
    model, _ = mixing_round(s, empty_model(spark, p), n)
    assert "CoGroup" not in model.factors._jdf.queryExecution().toString()


@pytest.fixture
def far_numbers(monkeypatch):
    """Categories of the queries are numbered as if those of a million users came before them, so that numbers go on beyond 2**20. Returns by how much."""
    from sparseloom import queries

    plain, shift = queries.enc.dictionaries, (1 << 20) - 10
    monkeypatch.setattr(queries.enc, "dictionaries", lambda train, columns, first=1: plain(train, columns, first + shift))
    return shift


def test_mixing_query_keeps_all_features(spark, small, far_numbers, monkeypatch):
    """Features beyond 2**20 train as others do: a linear model is the same whatever their numbers are."""
    from sparseloom import queries

    far = {r["feat"]: (r["w"], r["n"], r["z"], r["loss"]) for r in queries.ftrl_mixing_lr(spark, small).collect()}
    monkeypatch.undo()
    near = {r["feat"]: (r["w"], r["n"], r["z"], r["loss"]) for r in queries.ftrl_mixing_lr(spark, small).collect()}
    assert far.keys() == {f + far_numbers * (f > 0) for f in near} and max(far) > 1 << 20
    for f, state in near.items():
        assert far[f + far_numbers * (f > 0)] == pytest.approx(state, rel=1e-6)


@pytest.mark.parametrize("kind", ["FM", "FFM"])
@pytest.mark.parametrize("name", ["ftrl_mixing_{}", "ftrl_mixing_{}_documents"])
def test_mixing_queries_keep_all_factors(spark, small, far_numbers, name, kind):
    from sparseloom import queries

    s = queries.document_samples(spark, small) if "documents" in name else queries.samples(spark, small)
    x = s.select(F.explode("x").alias("e")).select("e.field", "e.feat").distinct().collect()
    assert len({r["feat"] for r in x}) == len(x) and max(r["feat"] for r in x) > 1 << 20  # no feature stands for two fields
    rows = queries.QUERIES[name.format(kind.lower())](spark, small).filter("v IS NOT NULL").select("feat").distinct().collect()
    assert {r["feat"] for r in rows} == {r["feat"] for r in x}


def test_bucketed_lines_keep_all_parts(spark, small, duck, same_rows, tmp_path):
    """Keys of parts beyond 2**20, against SQL."""
    from sparseloom import queries

    li = spark.read.parquet(f"{small}/lineitem.parquet")
    li.withColumn("l_partkey", F.col("l_partkey") + (1 << 20)).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    sql = queries.ORACLES["ftrl_bucketed_lines"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    same_rows(queries.ftrl_bucketed_lines(spark, str(tmp_path)), duck, sql)


@pytest.mark.parametrize("online", [True, False])
def test_tasks_with_bad_lines(spark, tmp_path, online):
    """In a tolerant mode lines that can't be read train nothing, alone or online; else they end the task."""
    for name, lines in (("clean", LINES), ("dirty", LINES[:5] + ["1 5 7", "", "x 1:1:1"] + LINES[5:])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.txt").write_text("\n".join(lines))
    one = {k: str(tmp_path / k) for k in ("clean", "dirty")}
    clean = run(spark, params("LR", online=online, train_data=one["clean"]))[1]
    for mode in ("DROPMALFORMED", "PERMISSIVE"):
        got = run(spark, params("LR", online=online, mode=mode, train_data=one["dirty"]))[1]
        assert got[0].train_loss == pytest.approx(clean[0].train_loss)
    with pytest.raises(Exception):
        run(spark, params("LR", online=online, train_data=one["dirty"]))


@pytest.mark.parametrize("online", [True, False])
def test_stopped_tasks_go_on(spark, tmp_path, monkeypatch, online):
    """A task that dies in its second epoch (a pass, in its second batch) and is run again ends as one that never died, and does nothing twice."""
    from sparseloom.operators import versions
    from sparseloom.plans import tasks

    (tmp_path / "train").mkdir()
    for i in range(2):
        (tmp_path / "train" / f"{i}.txt").write_text("\n".join(LINES[i * 5 : i * 5 + 5]))
    given = dict(online=online, n_epochs=2, train_data=str(tmp_path / "train"), eval_data=str(tmp_path / "train"))
    p = params("LR", **given)
    want_model, want = run(spark, p)
    work = str(tmp_path / "work")
    written, real = [], versions.ModelLog._write

    def failing(self, place, tables):
        if len(written) == (4 if online else 2):
            written.append("died")
            raise RuntimeError("died")
        real(self, place, tables)
        written.append(place)

    monkeypatch.setattr(versions.ModelLog, "_write", failing)
    with pytest.raises(Exception, match="died"):
        run(spark, params("LR", **given, work_path=work))
    model, epochs = run(spark, params("LR", **given, work_path=work))
    assert [e.train_loss for e in epochs] == pytest.approx([e.train_loss for e in want]) and [e.eval_loss for e in epochs] == pytest.approx([e.eval_loss for e in want])
    state = lambda m: {r["feat"]: r["z"] for r in m.linear.collect()}
    assert state(model) == pytest.approx(state(want_model))
    if online:
        assert len(written) == 1 + 2 * (1 + 2)  # each pass starts a log and has two steps; one of them was begun twice
    else:
        assert len(written) == 1 + 1 + 2
    with pytest.raises(ValueError, match="another task"):
        run(spark, params("FM", online=online, w_l1=0.5, train_data=p.train_data, work_path=work))


@pytest.mark.parametrize("kind", ["LR", "FM", "FFM"])
def test_changes_are_what_a_step_touches(spark, samples, kind, monkeypatch, tmp_path):
    """A log of small steps equals whole models, step by step and over compactions; bytes of a step follow what it touches."""
    from sparseloom.operators import versions
    from sparseloom.operators.versions import ModelLog
    from sparseloom.plans.batch import batch_changes

    monkeypatch.setattr(versions, "CHANGES", 2)
    p = params(kind, factor_init="warm")
    log, whole = ModelLog(spark, str(tmp_path / "log"), p), empty_model(spark, p)
    assert log.last() is None
    log.start(whole)
    for i in range(3):
        part = samples.filter(F.col("seq") % 3 == i)
        done = batch_changes(part, log.read(i))
        whole, losses = batch_step(part, whole)
        assert sorted(map(tuple, done.losses.select("seq", F.round("loss", 9)).collect())) == sorted(map(tuple, losses.select("seq", F.round("loss", 9)).collect()))
        log.append(i + 1, done.linear, done.factors)
        assert done.linear.count() == part.select(F.explode("x")).select("col.feat").distinct().count() + 1
        log.compact()
        rows = lambda df: sorted((tuple(r[c] for c in r.__fields__ if c in ("feat", "field")), tuple(map(float, r["z"])) if isinstance(r["z"], list) else (r["z"],)) for r in df.collect())
        for a, b in ((log.read().linear, whole.linear), *([] if kind == "LR" else [(log.read().factors, whole.factors)])):
            got, want = rows(a), rows(b)
            assert [k for k, _ in got] == [k for k, _ in want] and all(x == pytest.approx(y) for (_, x), (_, y) in zip(got, want))
    assert log.last() == 3 and len(log._versions("base")) <= 2
    with pytest.raises(ValueError):
        log.read(99)


@pytest.mark.parametrize("kind", ["FM", "FFM"])
def test_field_blocks_against_pairs(spark, kind):
    """Logits and gradients by sums equal those pair by pair, for fields with several entries and entries that repeat."""
    import random

    from sparseloom.plans.batch import ffm_gradients, fm_gradients, scored_rows
    from sparseloom.functions.expressions import sigmoid

    rnd, k, p = random.Random(3), 3, params(kind, n_factors=3, n_feats=9, factor_init="parity")
    rows = [(i, i % 2, [(rnd.randrange(3), rnd.randrange(6), rnd.choice((1.0, 0.5, -2.0))) for _ in range(rnd.randrange(7))]) for i in range(30)] + [(99, 1, [(1, 2, 1.0), (1, 2, 1.0)])]
    df = spark.createDataFrame(rows, "seq long, y int, x array<struct<field: int, feat: int, value: float>>")
    w = {f: rnd.gauss(0, 1) for f in range(-1, 5)}  # feature 5 has no row, nor have some factors
    key = [(f, g) for f in range(5) for g in range(3) if (f, g) != (1, 1)] if kind == "FFM" else [(f,) for f in range(5)]
    v = {c: [rnd.gauss(0, 0.5) for _ in range(k)] for c in key}
    linear = spark.createDataFrame(list(w.items()), "feat int, w double")
    factors = spark.createDataFrame([(*c, x) for c, x in v.items()], "feat int, field int, v array<double>" if kind == "FFM" else "feat int, v array<double>")
    of = lambda feat, field: v.get((feat, field) if kind == "FFM" else (feat,), [0.0] * k)
    scored = scored_rows(df, linear, factors, p).withColumn("e", sigmoid(F.col("logit")) - F.col("y"))
    logit = {}
    want = {}
    for seq, y, x in rows:
        s = w[-1] + sum(w.get(i, 0.0) * c for _, i, c in x)
        each = []
        for a in range(len(x)):
            for b in range(a + 1, len(x)):
                (f, i, c), (g, j, d) = x[a], x[b]
                vi, vj = of(i, g), of(j, f)
                s += sum(m * n for m, n in zip(vi, vj)) * c * d
                each += [((i, g), vj, c * d), ((j, f), vi, c * d)]
        logit[seq], e = s, 1 / (1 + math.exp(-s)) - y
        if kind == "FM":
            each = []
            total = [sum(of(i, 0)[t] * c for _, i, c in x) for t in range(k)]
            each = [((i,), [c * total[t] - of(i, 0)[t] * c * c for t in range(k)], 1.0) for _, i, c in x]
        for at, other, xx in each:
            g, q = want.setdefault(at, ([0.0] * k, [0.0] * k))
            for t in range(k):
                g[t] += e * xx * other[t]
                q[t] += (e * xx * other[t]) ** 2
    assert {r["seq"]: r["logit"] for r in scored.collect()} == pytest.approx(logit)
    got = {((r["feat"], r["field"]) if kind == "FFM" else (r["feat"],)): r for r in (ffm_gradients if kind == "FFM" else fm_gradients)(scored, k).collect()}
    assert got.keys() == want.keys()
    for at, (g, q) in want.items():
        assert got[at]["g"] == pytest.approx(g, abs=1e-9) and got[at]["q"] == pytest.approx(q, abs=1e-9)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # one row for each entry, none for pairs


@pytest.mark.parametrize("kind", ["LR", "FFM"])
def test_bucketed_training(spark, samples, kind):
    """Entries in buckets give what a plain step gives, hot features in several parts; the join has no exchange."""
    from sparseloom.plans.bucketed import Entries, train_bucketed

    p = params(kind, n_epochs=2, factor_init="warm")
    odd = samples.union(spark.createDataFrame([(77, 1, [])], samples.schema))
    got, want = train_bucketed(odd, p, buckets=3, most=2), train_batch(odd, p)
    for a, b in ((got.linear, want.linear), *([] if kind == "LR" else [(got.factors, want.factors)])):
        flat = lambda df: {(r["feat"], r["field"] if "field" in r else -1): r["z"] for r in df.collect()}
        one, two = flat(a), flat(b)
        assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)
    entries = Entries.write(odd, p, 3, 2)
    assert entries.parts.count() > 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = entries.met(got.linear.filter("feat >= 0").select("feat", "w", F.lit(None).alias("blocks")))
        met.collect()
        plan = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" in plan and "Exchange" not in plan


@pytest.mark.parametrize("kind", ["LR", "FFM"])
def test_shards_keep_their_state_over_batches(spark, tmp_path, kind):
    """A stream of small batches, stopped and started again, ends as one shard that took the lines one after another."""
    from sparseloom.sources.line_stream import bounded_lines
    from sparseloom.streaming.fold import fold_stream, folded_model

    p = params(kind, factor_init="warm")
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(LINES[k * 5 : k * 5 + 5]) + "\n")
        losses = fold_stream(bounded_lines(spark, str(tmp_path / "in"), str(tmp_path / "log"), 60), p, "libffm", 1, str(tmp_path / "state"), str(tmp_path / "out"))
    fold = Fold(p)
    want = sum(fold.learn(y, [(i, f, 1.0) for i, f in enumerate(x)]) for y, x in ROWS)
    model = folded_model(spark, p, str(tmp_path / "state"))
    assert losses.count() >= 4 and losses.agg(F.sum("loss")).first()[0] == pytest.approx(want) and losses.agg(F.sum("rows")).first()[0] == 10
    assert {r["feat"]: (r["n"], r["z"]) for r in model.linear.collect()} == {f: pytest.approx((float(s[1]), float(s[2]))) for f, s in fold.linear.items()}
    if kind == "FFM":
        assert {(r["feat"], r["field"]): r["z"] for r in model.factors.collect()} == {c: pytest.approx(s[2].tolist()) for c, s in fold.factors.items()}


@pytest.mark.parametrize("kind", ["LR", "FFM"])
def test_samples_pass_through_a_shard(spark, samples, kind):
    """A task of many samples holds none but those of a batch: batches come in one by one, and what the fold knew of before goes on."""
    from sparseloom.plans import mixing

    p = params(kind, factor_init="warm")
    fold = Fold(p)
    for _ in range(2):
        for y, x in ROWS:
            fold.learn(y, [(i, f, 1.0) for i, f in enumerate(x)])
    first = mixing_round(samples, empty_model(spark, p), 1)[0]
    model, losses = mixing_round(samples, first, 1)
    assert {r["feat"]: r["z"] for r in model.linear.collect()} == {f: pytest.approx(float(s[2]), rel=1e-5) for f, s in fold.linear.items()}
    assert losses.first()["n"] == 10

    import pyarrow as pa

    kind_of_x = pa.list_(pa.struct([("field", pa.int32()), ("feat", pa.int32()), ("value", pa.float32())]))
    taken = []

    def stream():
        for i, (y, x) in enumerate(ROWS * 50):
            taken.append(i)
            entries = pa.array([[{"field": k, "feat": f, "value": 1.0} for k, f in enumerate(x)]], kind_of_x)
            yield pa.RecordBatch.from_arrays([pa.array([i // 250], pa.int32()), pa.array([0], pa.int32()), pa.array([y], pa.int32()), entries, pa.nulls(1)], ["shard", "epoch", "y", "x", "state"])

    next(mixing._fold(p, 1, stream()))
    assert len(taken) == 251  # the first shard is given out before the second one is read


def test_linear_steps_collect_no_lists(spark, samples):
    """Sums of a linear model come back to the entries that samples hold; samples without entries and one without a key count too."""
    from sparseloom.plans.batch import current, scored_rows

    p = params("LR")
    odd = samples.union(spark.createDataFrame([(77, 1, []), (None, 1, [(0, 3, 2.0)])], samples.schema))
    model = train_batch(odd, p)
    weights = {r["feat"]: r["w"] for r in model.linear.collect()}
    scored = scored_rows(odd, *current(model), p)
    assert "collect_list" not in scored._jdf.queryExecution().optimizedPlan().toString()
    got = {r["seq"]: (r["y"], r["logit"], [tuple(e) for e in r["entries"]]) for r in scored.collect()}
    rows = [(i, y, [(f, 1.0) for f in x]) for i, (y, x) in enumerate(ROWS)] + [(77, 1, []), (None, 1, [(3, 2.0)])]
    assert got == {i: (y, pytest.approx(weights[-1] + sum(weights[f] * v for f, v in x)), x) for i, y, x in rows}


@pytest.mark.parametrize("kind", ["FM", "FFM"])
def test_gradients_are_summed_before_they_are_rows(spark, samples, kind):
    """A batch of samples gives a row for each coordinate that it has, not one for each entry and field."""
    from sparseloom.plans.batch import current, ffm_gradients, fm_gradients, scored_rows

    p = params(kind, factor_init="warm")
    twice = samples.union(samples.withColumn("seq", F.col("seq") + 100)).coalesce(1)
    scored = scored_rows(twice, *current(train_batch(twice, p)), p).withColumn("e", F.lit(0.5)).coalesce(1)
    sums = (fm_gradients if kind == "FM" else ffm_gradients)(scored, p.n_factors)
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "explode" not in plan.split("MapInArrow")[0]
    assert sums.count() == sums.select(*sums.columns[:-2]).distinct().count() > 0


def test_linear_steps_over_buckets_collect_no_lists(spark, samples, monkeypatch):
    from sparseloom.plans import bucketed

    plans, step = [], bucketed.step_of
    monkeypatch.setattr(bucketed, "step_of", lambda scored, *more: plans.append(scored._jdf.queryExecution().optimizedPlan().toString()) or step(scored, *more))
    bucketed.train_bucketed(samples, params("LR"), buckets=3, most=2)
    assert len(plans) == 1 and "collect_list" not in plans[0]


def _common(spark):
    """300 samples that share feature 7, some twice or out of range; others lack entries, or entries at all."""
    x = "CASE WHEN id % 50 = 9 THEN NULL WHEN id % 50 = 10 THEN array() ELSE array(struct(0 AS field, 7 AS feat, float(1) AS value), named_struct('field', 1, 'feat', int(id % 11 + 10), 'value', float(id / 100)), named_struct('field', 1, 'feat', 7, 'value', float(0.5)), named_struct('field', 1, 'feat', 99, 'value', float(1))) END"
    return spark.range(300).selectExpr("IF(id = 5, NULL, id) AS seq", "int(id % 3 = 0) AS y", f"CAST({x} AS array<struct<field: int, feat: int, value: float>>) AS x")


@pytest.mark.parametrize("most", [1, 40, 10**6])
def test_linear_blocks(spark, most):
    """Sums and scores by blocks are those of all entries; what comes back for a feature of all samples are as many rows as blocks."""
    from sparseloom.functions.expressions import sigmoid
    from sparseloom.operators.blocks import block_gradients, block_logits
    from sparseloom.plans.batch import current, linear_gradients, scored_rows

    df = _common(spark)
    p = params("LR", init_stddev=0.5)
    model = train_batch(df.filter("seq < 200"), p)
    linear = current(model)[0]
    scored = scored_rows(df.withColumn("x", F.filter("x", lambda e: e.feat < 50)), linear, None, p).withColumn("e", sigmoid(F.col("logit")) - F.col("y"))
    rows = block_gradients(df, linear, p, most).collect()
    got = {}
    for r in rows:
        if r["feat"] is not None:
            got.setdefault(r["feat"], []).append((r["g"], r["q"]))
    want = {r["feat"]: (r["g"], r["q"]) for r in linear_gradients(scored).collect()}
    assert got.keys() == want.keys()
    for f, parts in got.items():
        assert [sum(v) for v in zip(*parts)] == pytest.approx(list(want[f]))
    total = df.select(F.sum(F.greatest(F.size("x"), F.lit(1)))).first()[0]
    assert len(got[7]) <= -(-total // most)
    by_seq = lambda rows: {r["seq"]: (r["y"], pytest.approx(r["logit"])) for r in rows}
    assert by_seq(r for r in rows if r["feat"] is None) == {r["seq"]: (r["y"], r["logit"]) for r in scored.collect()}
    fresh = empty_model(spark, p)  # features that training never saw have their initial weights
    for m in (model, fresh):
        assert by_seq(block_logits(df, m, most).collect()) == {r["seq"]: (r["y"], r["logit"]) for r in logits(df, m).collect()}


def test_linear_step_without_samples(spark):
    new, losses = batch_step(_common(spark).limit(0), empty_model(spark, params("LR")))
    assert new.linear.count() == 0 and losses.count() == 0


def test_online_linear_steps_go_by_blocks(spark, tmp_path, monkeypatch):
    """Neither a step nor an evaluation joins entries with weights one by one."""
    from sparseloom.plans import batch
    from sparseloom.streaming import online

    plans, keep, loss = [], batch.materialize, online.mean_loss
    plan = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    monkeypatch.setattr(batch, "materialize", lambda df, purpose: plan(df) or keep(df, purpose))
    monkeypatch.setattr(online, "mean_loss", lambda df, *more: plan(df) or loss(df, *more))
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "a.txt").write_text("\n".join(LINES))
    run(spark, params("LR", train_data=str(tmp_path / "train"), eval_data=str(tmp_path / "train")))
    scored = [p for p in plans if "Generate explode" in p]
    assert len(scored) == 2 and all("FlatMapCoGroupsInArrow" in p for p in scored)
