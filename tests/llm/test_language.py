import numpy as np

from sparseloom.llm.language import ORDER, Model, Scorer, Tree, gram_counts, held_out, op5_language_id, predict, train
from pyspark.sql import functions as F


def tree():
    return Tree(*gram_counts([b"the cat sat on the mat", b"a cat and a hat", "épée".encode()]))


def test_probabilities_sum_to_one():
    t = tree()
    for context in (b"the ", b" cat", b"zzzz", b"\xc3\xa9p\xc3", b"    "):
        keys = np.array([int.from_bytes(context[-ORDER:] + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs(np.exp2(-t.code_lengths(keys)).sum() - 1) < 1e-9


def test_code_lengths_by_hand():
    """'b' after 'a' in 'abab': the longest known context decides, and escapes go to shorter ones."""
    t = Tree(*gram_counts([b"abab"]))
    key = int.from_bytes(b"zzzab"[-ORDER - 1 :], "big")
    # context 'a' was seen twice, always before b: 2 / (2 + 1)
    assert abs(t.code_lengths(np.array([key], np.uint64))[0] - np.log2(3 / 2)) < 1e-12


def test_scorer_sums_whole_texts():
    t = tree()
    scorer, text = Scorer([t]), "The hat sat\non a mat é"
    raw = b" " * ORDER + text.encode().lower()
    keys = np.array([int.from_bytes(raw[i : i + ORDER + 1], "big") for i in range(len(raw) - ORDER)], np.uint64)
    got = scorer.batch(["x", text, "", text])
    assert abs(got[1, 0] - t.code_lengths(keys).sum()) < 1e-3 and got[1, 0] == got[3, 0] and got[2, 0] == 0


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang", "text")
    got = op5_language_id(spark, small).join(docs, "doc_id").filter("held_out AND length(text) > 40").select((F.col("lang") == F.col("lang_pred")).alias("ok"), "score").collect()
    assert sum(r["ok"] for r in got) >= 0.97 * len(got) > 10 and all(0 <= r["score"] <= 1 for r in got)


def test_edges(spark, make_docs, edges):
    model = Model({"en": gram_counts([b"one of the words in a line"]), "fr": gram_counts(["été où ça".encode()])})
    got = predict(make_docs([*edges, (50, "123 456 ..."), (51, "the line of words")]), model)
    pred = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert got.count() == len(edges) + 2
    assert pred[1] == pred[2] == pred[3] == pred[50] == ("und", 0.0) and pred[51][0] == "en"
    nothing = predict(make_docs(edges), train(make_docs([])))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_training_is_the_same_each_time(make_docs):
    docs = make_docs([(i, f"text number {i} of some kind") for i in range(50)])
    a, b = train(docs, sample_texts=10), train(docs.repartition(3), sample_texts=10)
    assert all((x == y).all() for s, t in zip(a.trees, b.trees) for x, y in zip(s.counts, t.counts))


def test_fold(spark):
    import zlib

    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_counts_in_executors_are_those_of_the_texts(make_docs):
    """Trees grown from distributed counts are the trees of the texts themselves; every language is learned, however many there are."""
    rows = [(i, f"text number {i} of kind {i % 7}, été") for i in range(60)]
    docs = make_docs(rows).withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 30).cast("string"))).repartition(5)
    model = train(docs)
    assert model.languages == sorted(f"l{k}" for k in range(30))
    for lang, tree_ in zip(model.languages, model.trees):
        want = Tree(*gram_counts([t.encode() for i, t in rows if f"l{i % 30}" == lang]))
        assert all((a == b).all() for x, y in ((tree_.grams, want.grams), (tree_.counts, want.counts), (tree_.total, want.total)) for a, b in zip(x, y))


def test_ties_go_to_the_first_name(make_docs):
    same = gram_counts([b"the same words"])
    got = predict(make_docs([(1, "the same words"), (2, "other ones")]), Model({"zz": same, "aa": same, "mm": same}))
    assert {r["lang_pred"] for r in got.collect()} == {"aa"} and all(abs(r["score"] - 1 / 3) < 1e-6 for r in got.collect())


def test_long_text(make_docs):
    model = Model({"en": gram_counts([b"one of the words in a line"]), "fr": gram_counts(["des mots dans une ligne".encode()])})
    got = predict(make_docs([(1, "the words in one line " * 150_000), (2, "une ligne des mots " * 100_000)]), model)
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "en", 2: "fr"}


def test_all_grams_of_the_sample_count(make_docs):
    """Nothing is left out of what was picked; with many languages the rows in all are bounded."""
    docs = make_docs([(i, " ".join(f"{i * 7 + k:x}" for k in range(300))) for i in range(40)])
    model = train(docs, sample_texts=40)
    want = Tree(*gram_counts([" ".join(f"{i * 7 + k:x}" for k in range(300)).encode() for i in range(40)]))
    assert all((a == b).all() for a, b in zip(model.trees[0].counts, want.counts))
    many = docs.withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 20).cast("string")))
    some = train(many, sample_rows=20)
    assert len(some.languages) == 20 and sum(int(t.counts[0].sum()) for t in some.trees) < int(want.counts[0].sum())
