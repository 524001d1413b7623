import numpy as np
import pytest

from sparseloom.llm.pseudo_likelihood import CLASSES, GRID, SIDE, Classes, Network, _encoded, _neighbours, _round, score, start_values, train, word_counts
from tests.llm.conftest import words


def some_network(texts, top):
    classes = Classes(top)
    ids = [np.array([classes[w] for w in t.encode().split()]) for t in texts]
    return Network(start_values(*brute_counts(ids, CLASSES))), ids


def brute_counts(ids, classes):
    """Class frequencies and counts of pairs, one by one."""
    frequencies, pairs = np.zeros(classes), np.zeros((SIDE, classes + 1, classes + 1))
    for text in ids:
        row = [classes] * SIDE + list(text) + [classes] * SIDE
        for c in text:
            frequencies[c] += 1
        for d in range(1, SIDE + 1):
            for a, b in zip(row, row[d:]):
                pairs[d - 1, a, b] += (a, b) != (classes, classes)
    return frequencies, pairs


def brute_log_probs(values, ids):
    """log P(class | both sides) place by place, in plain arithmetic."""
    e, w1, b1, w2, b2 = (p.astype(float) for p in Network(values).parts)
    end = len(b2)
    row = [end] * SIDE + list(ids) + [end] * SIDE
    out = []
    for k in range(SIDE, len(row) - SIDE):
        sides = row[k - SIDE : k] + row[k + 1 : k + SIDE + 1]
        x = np.concatenate([e[o][c] for o, c in enumerate(sides)])
        z = np.tanh(x @ w1 + b1) @ w2 + b2
        out.append(z[row[k]] - np.log(np.exp(z).sum()))
    return out


def test_gradient():
    """The gradient is that of finite differences of the brute-force sum."""
    net, ids = some_network(["a b a b c", "b a c c a b"], [b"a", b"b"])
    got = sum(net.text_gradient(t) for t in ids) / GRID
    loss = lambda v: -sum(sum(brute_log_probs(v, t)) for t in ids)
    rng = np.random.default_rng(1)
    for i in {*np.argsort(-np.abs(got))[:15].tolist(), *rng.integers(0, len(got), 15).tolist()}:
        up, down = net.values.astype(float), net.values.astype(float)
        up[i] += 1e-2
        down[i] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - got[i]) < 2e-3 + 2e-3 * abs(got[i])
    assert got.any() and (got * GRID == np.rint(got * GRID)).all()


def test_scores_by_hand(make_docs):
    docs = make_docs([(i, " ".join(words(i, 80, 30))) for i in range(60)])
    model = train(docs)
    classes = Classes(model.top)
    text = "w1 w2 w3"
    got = score(make_docs([(1, text)]), model).first()
    want = sum(brute_log_probs(model.values, [classes[w] for w in text.encode().split()]))
    assert got["n_tokens"] == 3 and abs(got["log_prob"] - want) < 1e-4 and abs(got["mean_log_prob"] - want / 3) < 1e-4


def test_training_by_brute_force(make_docs):
    """Counts, start and the first rounds, with gradients by finite differences of the directions that were taken."""
    rows = [(i, " ".join(words(i, 60, 25))) for i in range(40)]
    model = train(make_docs(rows))
    v = model.vocabulary
    classes = Classes(model.top, v.tops, v.buckets)
    ids = [np.array([classes[w] for w in t.encode().split()]) for _, t in rows]
    encoded = _encoded(make_docs(rows).select("text"), model.top, v.tops, v.buckets)
    frequencies, pairs = brute_counts(ids, v.tops + v.buckets)
    assert all((a == b).all() for a, b in zip(_neighbours(encoded, v.tops + v.buckets), pairs))
    start = start_values(frequencies, pairs)
    mean = lambda x: np.mean([p for t in ids for p in brute_log_probs(x, t)])
    prob = (frequencies + 1) / (frequencies + 1).sum()
    unigram = np.mean([np.log(prob[c]) for t in ids for c in t])
    assert mean(model.values) > mean(start) > unigram
    n, gradient = _round(encoded, start)
    assert n == sum(map(len, ids)) and (gradient == sum(Network(start).text_gradient(t) for t in ids)).all()


@pytest.mark.parametrize("parts", [4, 16])
def test_partitions_change_nothing(spark, small, parts):
    """Parameters and scores are equal, to the last bit, however texts are dealt out."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one, many = (train(docs.repartition(k)) for k in (1, parts))
    assert (one.values == many.values).all() and one.top == many.top
    a, b = (sorted(map(tuple, score(docs.repartition(k), m).collect())) for k, m in ((1, one), (parts, many)))
    assert [r[:2] for r in a] == [r[:2] for r in b]
    assert all(x[2] == pytest.approx(y[2], rel=1e-12) for x, y in zip(a, b))


def test_better_than_frequencies_on_held_out_text(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("length(text) > 200").dropDuplicates(["text"])
    model = train(docs.filter("doc_id % 5 != 0"))
    v = model.vocabulary
    classes = Classes(model.top, v.tops, v.buckets)
    ids = [[classes[w] for w in r["text"].encode().split()] for r in docs.filter("doc_id % 5 = 0").collect()]
    net, n = Network(model.values), sum(map(len, ids))
    bias = start_values(*brute_counts([np.array(t) for r in docs.filter("doc_id % 5 != 0").collect() for t in [[classes[w] for w in r["text"].encode().split()]]], v.tops + v.buckets))[-(v.tops + v.buckets):]
    assert sum(net.log_prob(np.array(t)) for t in ids) / n > sum(bias[c] for t in ids for c in t) / n + 0.1


def test_one_long_text(make_docs):
    long = " ".join(words(3, 300_000, 2000))
    rows = [(1, long), (2, long), (3, "a short one")]
    got = {r["doc_id"]: r for r in score(make_docs(rows), train(make_docs(rows))).collect()}
    assert got[1]["n_tokens"] == 300_000 and got[1]["log_prob"] == got[2]["log_prob"] < got[3]["log_prob"] < 0


def test_learns_both_sides(make_docs):
    """Held-out text of the same kind scores better than its words in another order, and than under word frequencies."""
    rng = np.random.default_rng(0)

    def sentence(n):
        return " ".join(f"{s} {v} {o}" for s, v, o in zip(rng.choice(["he", "she", "it"], n), rng.choice(["sees", "has", "likes"], n), rng.choice(["apples", "pears", "plums"], n)))

    model = train(make_docs([(i, sentence(40)) for i in range(300)]))
    good = sentence(100)
    mixed = " ".join(rng.permutation(good.split()))
    got = {r["doc_id"]: r["mean_log_prob"] for r in score(make_docs([(1, good), (2, mixed)]), model).collect()}
    assert got[1] > got[2] + 0.5 and got[1] > np.log(1 / 9) + 0.5


def test_counts_and_edges(make_docs, edges):
    from collections import Counter

    docs = make_docs(edges)
    want = Counter(w for _, t in edges for w in (t or "").encode().split())
    assert {bytes(r["word"]): r["n"] for r in word_counts(docs.filter("text IS NOT NULL")).collect()} == want
    got = score(docs, train(docs)).collect()
    assert len(got) == len(edges)
    assert all((r["n_tokens"] == 0) == (r["mean_log_prob"] is None) and np.isfinite(r["log_prob"]) for r in got)
    nothing = make_docs([(1, None)])
    assert train(nothing) is None and score(nothing, None).first()["log_prob"] == 0


def test_every_word_has_its_own_probability(make_docs, monkeypatch):
    """Words of one bucket differ by their counts, whether their counts are known to every worker or met in the table; unseen ones cost most."""
    from collections import Counter

    from sparseloom.llm import pseudo_likelihood as pl

    rows = [(i, " ".join(words(i, 300, 4000))) for i in range(60)]
    n = Counter(w for _, t in rows for w in t.encode().split())
    got = []
    for share in (pl.SHARE, 300):
        monkeypatch.setattr(pl, "SHARE", share)
        model = train(make_docs(rows))
        v = model.vocabulary
        classes = Classes(model.top, v.tops, v.buckets)
        assert (len(v.head) < len(n) / 2) == (share == 300)
        for b in range(v.buckets):
            assert v.in_bucket[b] == sum(n[w] for w in n if classes[w] == v.tops + b)
        by_class = {}
        for w in sorted(n, key=lambda w: -n[w]):
            by_class.setdefault(classes[w], []).append(w)
        bucket = max(by_class.values(), key=len)
        often, rare = bucket[0], bucket[-1]
        unseen = next(w for w in (f"new{i}".encode() for i in range(10000)) if classes[w] == classes[rare])
        one = {r["doc_id"]: r["log_prob"] for r in score(make_docs([(i, w.decode()) for i, w in enumerate((often, rare, unseen))]), model).collect()}
        assert n[often] > n[rare]
        assert abs(one[0] - one[1] - np.log(n[often] / n[rare])) < 1e-6 and abs(one[1] - one[2] - np.log(n[rare] / pl.UNSEEN)) < 1e-6
        net = Network(model.values)
        p = net.forward(np.array([v.tops + v.buckets] * SIDE + [classes[rare]] + [v.tops + v.buckets] * SIDE), np.array([SIDE]))[3][0]
        seen = sum(p[classes[w]] * (n[w] / (v.in_bucket[classes[w] - v.tops] + pl.UNSEEN) if classes[w] >= v.tops else 1) for w in n)
        unknown = sum(p[v.tops + b] * pl.UNSEEN / (v.in_bucket[b] + pl.UNSEEN) for b in range(v.buckets))
        assert abs(seen + unknown - 1) < 1e-4
        got.append({r["doc_id"]: r["log_prob"] for r in score(make_docs(rows), model).collect()})
    assert got[0].keys() == got[1].keys() and all(abs(got[0][k] - got[1][k]) < 1e-3 for k in got[0])


def test_classes_grow_with_the_corpus():
    from sparseloom.llm.pseudo_likelihood import class_sizes

    assert class_sizes(1000) == (48, 16)
    assert sum(class_sizes(10**8)) > sum(class_sizes(10**7)) > CLASSES
    assert len(Network(start_values(np.ones(200), [np.ones((201, 201))] * SIDE)).parts[4]) == 200


def test_words_of_a_batch_are_looked_up_once():
    """Values and lengths are those of splitting text by text, by ASCII white space alone, and a word that a batch repeats costs one lookup."""
    import pyarrow as pa

    from sparseloom.llm.pseudo_likelihood import _numbered, code

    batch = ["", " ", "\n a\tb\x0bc\x0cd \r", "a b\x1cc\x85d\u2003e a", "\u00e9  a", "a " * 1000]
    asked = []

    class Lookup(Classes):
        def values(self, words):
            asked.extend(words)
            return super().values(words)

    got, n = _numbered(Lookup([b"a"]), pa.array(batch))
    want = [t.encode().split() for t in batch]
    assert n.tolist() == list(map(len, want)) and len(asked) == len(set(asked)) == len({w for ws in want for w in ws})
    assert got.tolist() == [0 if w == b"a" else 48 + code(w) % 16 for ws in want for w in ws]
