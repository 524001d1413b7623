import pytest
from pyspark.sql import functions as F

from sparseloom.functions.params import EncodeParams
from sparseloom.operators import encode as enc
from sparseloom.operators.filters import has_zero, in_range
from sparseloom.sources.sparse_text import detect_format, parse_by_pattern, parse_garbage_as_zero, parse_samples, read_lines, read_samples, write_lines
from sparseloom.sources.tabular import read_train_eval


def parsed(spark, lines, file_type, mode="FAILFAST"):
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, value string")
    return [r.asDict(True) for r in parse_samples(df, file_type, mode).orderBy("seq").collect()]


def entries(row):
    return [(e["field"], e["feat"], round(e["value"], 6)) for e in row["x"]]


def test_libffm(spark):
    got = parsed(spark, ["-1 0:2:1", "0.5  1:9:1   2:3:-2.5e-1", "1 0:2:1 1:13:0", "3 0:0:1e1"], "libffm")
    assert [r["y"] for r in got] == [0, 0, 1, 1]
    assert [entries(r) for r in got] == [[(0, 2, 1)], [(1, 9, 1), (2, 3, -0.25)], [(0, 2, 1)], [(0, 0, 10)]]


def test_libsvm(spark):
    got = parsed(spark, ["1 0:1 7:2.5", "1 5:1 5:2", "0"], "libsvm")
    assert [entries(r) for r in got] == [[(0, 0, 1), (0, 7, 2.5)], [(0, 5, 1), (0, 5, 2)], []]


BAD = ["1 5", "1 5:", "", "x 1:1", "1 1:1 2:3:4"]


def test_malformed_lines(spark):
    for line in BAD:
        with pytest.raises(Exception, match="wrong input"):
            parsed(spark, ["1 1:1", line], "libsvm")
    assert len(parsed(spark, ["1 1:1", *BAD, "0 2:1"], "libsvm", "DROPMALFORMED")) == 2
    kept = parsed(spark, ["1 1:1", *BAD], "libsvm", "PERMISSIVE")
    assert [r["_corrupt_record"] for r in kept] == [None, *BAD] and all(r["x"] is None for r in kept[1:])
    with pytest.raises(ValueError):
        parsed(spark, [], "arff")


def test_tolerant_readings(spark):
    df = spark.createDataFrame([(0, "1 0:2:1.5 junk 3:4:-1"), (1, "1 0:x:2 1:3:z")], "seq long, value string")
    by = parse_by_pattern(df).orderBy("seq").collect()
    assert [entries(r.asDict(True)) for r in by] == [[(0, 2, 1.5)], []]
    zero = parse_garbage_as_zero(df).orderBy("seq").collect()
    assert entries(zero[1].asDict(True)) == [(0, 0, 2.0)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"{i % 2} 0:{i}:1 1:{i + 1}:0.5" for i in range(10)))
    assert detect_format(spark, str(tmp_path / "a.txt")) == "libffm"
    got = read_samples(spark, str(tmp_path / "a.txt")).orderBy("seq").collect()
    assert len(got) == 10 and [(e["field"], e["feat"], e["value"]) for e in got[9].asDict(True)["x"]] == [(0, 9, 1.0), (1, 10, 0.5)]
    (tmp_path / "b.txt").write_text("1\n")
    with pytest.raises(ValueError):
        detect_format(spark, str(tmp_path / "b.txt"))


def test_range_filters(spark):
    x = [(1, -1, 3.0), (44, 0, 1.0), (1, 100, 0.0)]
    df = spark.createDataFrame([(x,)], "x array<struct<field: int, feat: int, value: float>>")
    assert df.select(F.size(in_range(F.col("x"), 50)), F.size(in_range(F.col("x"), 50, 4))).first() == (1, 0)


def test_has_zero(spark):
    assert has_zero(spark.createDataFrame([([1.0, 0.0],), ([2.0],)], "v array<double>"), "v").first()[0] is True
    assert has_zero(spark.createDataFrame([], "w double"), "w").first()[0] is False


CSV = "label,cat_a,num_i,cat_b,num_f\n" + "\n".join(f"{i % 3},{'abcde'[i % 5]},{i},{10 * (i % 4)},{i / 8}" for i in range(40))


def test_encoding_of_a_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    (tmp_path / "e.csv").write_text("label,cat_a,num_i,cat_b,num_f\n2,zz,0,10,9.75\n0,a,78,99,0.12345\n")
    p = EncodeParams(label_col=0, cat_cols=(1, 3), num_cols=(2, 4), threshold=1, normalize=True)
    train, held = (d.withColumn("seq", F.monotonically_increasing_id()) for d in read_train_eval(spark, p, train_path=str(tmp_path / "t.csv"), eval_path=str(tmp_path / "e.csv")))
    a, b = enc.transform(train, held, p, "seq")
    assert a.agg(F.sum("y"), F.count("*")).first() == (13, 40)
    lines = [r["value"] for r in enc.lines(b, "libffm").orderBy("seq").collect()]
    # 5 letters are 1 to 5, 4 numbers 6 to 9, the two numeric columns 10 and 11
    assert lines == ["1 0:0:1.0 1:7:1.0 2:10:0.0 3:11:2.0", "0 0:1:1.0 1:0:1.0 2:10:2.0 3:11:0.0253"]
    write_lines(enc.lines(enc.shuffled(a, 1, "seq"), "libsvm"), str(tmp_path / "out"))
    assert read_samples(spark, str(tmp_path / "out"), "libsvm").count() == 40


def test_negative_sampling(spark, tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    p = EncodeParams(cat_cols=(1,), num_cols=(2, 4), neg_sampling=True, num_neg=2)
    train, held = (d.withColumn("seq", F.monotonically_increasing_id()) for d in read_train_eval(spark, p, data_path=str(tmp_path / "t.csv")))
    a, b = enc.transform(train, held, p, "seq")
    n = train.count()
    assert n + held.count() == 40
    assert a.groupBy("y").count().orderBy("y").collect() == [(0, 2 * n), (1, n)]
    low, high = train.agg(F.min("num_i"), F.max("num_i")).first()
    for r in a.filter("y = 0").collect():
        assert 1 <= r["x"][0]["feat"] <= 5 and low <= r["x"][1]["value"] <= high and r["x"][1]["value"] == int(r["x"][1]["value"])


def test_dictionary_in_order_of_values(spark):
    df = spark.createDataFrame([(v, s) for v, s in zip([10, 9, -3, 100000, 9, None], ["b", "a", None, "ab", "é", "b"])], "n long, s string")
    got = enc.dictionaries(df, ["n", "s"]).orderBy("feat").collect()
    assert [(r["field"], r["value"], r["feat"]) for r in got] == [(0, "-3", 1), (0, "9", 2), (0, "10", 3), (0, "100000", 4), (1, "a", 5), (1, "ab", 6), (1, "b", 7), (1, "é", 8)]


def test_constant_column(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0)], "id int, v double")
    assert [r["v"] for r in enc.min_max(df, enc.bounds(df, ["v"]), ["v"]).collect()] == [0.0, 0.0]


def test_encode_command(spark, tmp_path):
    from sparseloom.encode_cli import main

    (tmp_path / "t.csv").write_text(CSV)
    main(["--data_path", str(tmp_path / "t.csv"), "--train_output_path", str(tmp_path / "a"), "--eval_output_path", str(tmp_path / "b"), "--cat_cols", "1,3", "--num_cols", "2,4", "--threshold", "1", "--normalize", "true"])
    assert read_samples(spark, str(tmp_path / "a")).count() + read_samples(spark, str(tmp_path / "b")).count() == 40


def test_lines_in_order(spark, tmp_path):
    """Line numbers follow file names and places, however files are split and packed."""
    want = []
    for name, n in (("a.txt", 700), ("b.txt", 3), ("c.txt", 1500)):
        lines = [f"{name} {i} " + "x" * (i % 37) for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        want += lines
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        got = sorted((r["seq"], r["value"]) for r in read_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == list(enumerate(want))


def test_dictionary_of_numbers_and_long_names(spark):
    rows = [(float(x), f"Customer#{k:06d}", x % 3 == 0) for k, x in enumerate((2, 10, -1, 2, 0.5, 1e9, -300))]
    df = spark.createDataFrame(rows, "d double, s string, b boolean")
    words = enc.dictionaries(df, ["d", "s", "b"]).orderBy("feat").collect()
    assert [r["feat"] for r in words] == list(range(1, 16))
    assert [float(r["value"]) for r in words if r["field"] == 0] == sorted({r[0] for r in rows})
    assert [r["value"] for r in words if r["field"] == 1] == sorted(r[1] for r in rows)


def test_exact_split(spark, monkeypatch):
    """Exactly the share, the same rows however the table lies, with many equal rows and through several histograms."""
    from sparseloom.operators import order
    from sparseloom.sources.tabular import split

    monkeypatch.setattr(order, "FEW", 5)
    df = spark.range(500).selectExpr("id % 300 AS a", "CASE WHEN id < 200 THEN 1 ELSE id END AS b", "'x' AS first", "id AS _place")
    for share in (0.0, 0.003, 0.5, 0.8, 1.0):
        train, held = split(df.repartition(3), share, 7, "a", "b")
        assert train.count() == round(500 * share) and train.count() + held.count() == 500
        again, _ = split(df.repartition(5), share, 7, "a", "b")
        assert sorted((r["a"], r["b"]) for r in train.collect()) == sorted((r["a"], r["b"]) for r in again.collect())
    same = spark.createDataFrame([(1,)] * 90, "a int")
    train, held = split(same, 0.3, 1)
    assert (train.count(), held.count()) == (27, 63)
    assert [x.count() for x in split(same.limit(0), 0.3, 1)] == [0, 0]


def test_positions(spark):
    from sparseloom.operators.order import row_partitions, with_positions

    rows = [(i * 37 % 101, None if i % 9 == 0 else i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(6)
    got = with_positions(df, F.desc("b"), "a").orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(300))
    assert [(r["b"], r["a"]) for r in got] == sorted(((b, a) for a, b in rows), key=lambda t: (t[0] is None, -(t[0] or 0), t[1]))
    parts = row_partitions(df, 7, "a").groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in parts] == [43] * 6 + [42]
    assert with_positions(df.limit(0), "a").count() == 0 and row_partitions(df.limit(0), 7, "a").count() == 0


@pytest.mark.parametrize("text", [b"", b"\n", b"one", b"one\n", b"a\r\nbb\n\nccc", b"x" * 50 + b"\ny\n", "é\nü\n".encode()])
def test_ranges_of_lines(tmp_path, text):
    """Wherever a file is cut, each line comes once."""
    import pyarrow as pa

    from sparseloom.sources.line_stream import lines_of

    (tmp_path / "f").write_bytes(text)
    want = [line.removesuffix(b"\r") for line in text.split(b"\n")]
    want = want[:-1] if want[-1] == b"" else want
    for step in range(1, len(text) + 2):
        got = []
        for a in range(0, len(text), step):
            with pa.OSFile(str(tmp_path / "f")) as f:
                got += lines_of(f, a, min(a + step, len(text)))
        assert [line for _, line in got] == want and [at for at, _ in got] == sorted({at for at, _ in got})


def test_bounded_stream(spark, tmp_path):
    """Batches of so many bytes within and over files; new files are found; a stopped stream goes on, its failed batch comes again, nothing is lost."""
    from sparseloom.sources.line_stream import bounded_lines
    from sparseloom.streaming.online import run_through

    (tmp_path / "in").mkdir()
    lines = [f"line {i} " + "x" * (i % 7) for i in range(60)]
    (tmp_path / "in" / "b.txt").write_text("\n".join(lines[:40]) + "\n")
    (tmp_path / "in" / "_hidden").write_text("no\n")
    seen, die = {}, [3]

    def step(batch, k):
        rows = batch.orderBy("seq").collect()
        if k == die[0]:
            die[0] = None
            raise RuntimeError("died")
        assert k not in seen
        seen[k] = [r["value"] for r in rows]

    stream = lambda: bounded_lines(spark, str(tmp_path / "in"), str(tmp_path / "log"), 100, 30)
    with pytest.raises(Exception):
        run_through(stream(), step, str(tmp_path / "offsets"))
    assert sorted(seen) == [0, 1, 2]
    run_through(stream(), step, str(tmp_path / "offsets"))
    assert sum((seen[k] for k in sorted(seen)), []) == lines[:40] and len(seen) >= 5
    assert all(sum(len(v) + 1 for v in seen[k]) <= 220 for k in seen)
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines[40:]))
    run_through(stream(), step, str(tmp_path / "offsets"))
    assert sum((seen[k] for k in sorted(seen)), []) == lines


def test_tolerant_readers_read_a_line_once(spark):
    """What explodes the entries doesn't have them read again to filter empty ones away; numbers are read as far as they go."""
    from pyspark.sql import functions as F

    from sparseloom.sources.sparse_text import parse_garbage_as_zero

    lines = spark.createDataFrame([(0, "1 0:5:1.5 junk 1:6:-2.5e0x"), (1, ""), (2, "+1 1:99999999999:.5 -2:+7x:5.")], "seq long, value string")
    rows = parse_garbage_as_zero(lines).select("seq", "y", F.posexplode("x").alias("pos", "e"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 4
    assert sorted((r["seq"], r["y"], r["pos"], *r["e"]) for r in rows.collect()) == [(0, 1, 0, 0, 5, 1.5), (0, 1, 1, 0, 1, 6.0), (2, 1, 0, 1, 0, 0.5), (2, 1, 1, -2, 7, 5.0)]


@pytest.mark.parametrize("name", ["stream_train_bounded", "stream_fold_lr"])
def test_ordered_lines_are_not_sorted_in_one_task(spark, small, monkeypatch, name):
    """Files that a stream reads in order are written by ranges, and batches of bytes go on from file to file."""
    from sparseloom import queries

    given = []
    write = queries.write_lines
    monkeypatch.setattr(queries, "write_lines", lambda lines, path: (given.append(lines), write(lines, path)))
    queries.QUERIES[name](spark, small)
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Sort") and "Repartition" not in plan


@pytest.mark.parametrize("file_type", ["libsvm", "libffm"])
def test_plain_lines_are_read_as_others(spark, file_type):
    """Lines of the plain form have a short way; a space at the end sends them the long one."""
    n = 2 if file_type == "libsvm" else 3
    entry = lambda i, v: ":".join([str(i % 3), str(i), v][3 - n :])
    numbers = ["1", "0", "0.0", "-0.5", "+2", "0.1234567", "123456789.123456789", "999999999"]
    lines = ["1", "0 " + entry(999999999, "1"), "000000002 " + " ".join(entry(i, v) for i, v in enumerate(numbers))]
    assert parsed(spark, lines, file_type) == parsed(spark, [x + " " for x in lines], file_type)
    long = "1 " + " ".join(entry(i, "0.5") for i in range(100_000))
    assert len(parsed(spark, [long], file_type)[0]["x"]) == 100_000
    bad = ["1 " + entry(1, "1") + ":", "1 " + entry(1, ""), "1 1", "x", "1 " + entry(1, "1") + " 1:1:1:1"]
    assert [r["y"] for r in parsed(spark, bad + lines, file_type, "PERMISSIVE")] == [None] * len(bad) + [1, 0, 1]
