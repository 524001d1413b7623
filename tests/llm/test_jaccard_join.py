import random
from fractions import Fraction

import numpy as np
import pytest

from sparseloom.llm import jaccard_join
from sparseloom.llm.components import connected_components
from tests.llm.conftest import words


def brute(rows):
    """doc_id -> (class, links), all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    linked = {i: [j for j in ids if j != i and (sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]))] for i in ids}
    cls = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            m = min([cls[i], *(cls[j] for j in linked[i])])
            if m < cls[i]:
                cls[i], changed = m, True
    return {i: (cls[i], len(linked[i])) for i in ids}


def near_copies(seed, n, size, edits):
    rnd = random.Random(seed)
    base = words(seed, size, 5000)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.random()}"
        out.append(" ".join(w))
    return out


def got(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def test_groups_of_all_sizes(make_docs):
    texts = [t for s in range(12) for t in near_copies(s, 1 + s % 6, 60 + 30 * s, 1 + s // 2)] + [" ".join(words(900 + k, 50)) for k in range(30)]
    texts += [texts[0]] * 5 + [None, "", " \n", "a b", "a b", "a b c", "short one"]
    rows = list(enumerate(texts))
    assert got(jaccard_join.jaccard_join(make_docs(rows))) == brute(rows)


def test_group_of_several_blocks(make_docs, monkeypatch):
    """Blocks are compared two by two: no link is lost or counted twice, whatever the deal."""
    rows = list(enumerate(near_copies(77, 60, 120, 4)))
    want = brute(rows)
    for size in (3, 25):
        monkeypatch.setattr(jaccard_join, "BLOCK", size)
        assert got(jaccard_join.jaccard_join(make_docs(rows))) == want


def test_repeated_and_missing_ids(make_docs, edges):
    rows = [(i, t) for i, t in edges if i is not None]
    assert got(jaccard_join.jaccard_join(make_docs(edges))) == brute(rows)
    twice = jaccard_join.jaccard_join(make_docs([(1, "a b c d e f g"), (1, "h i j k l m"), (2, "a b c d e f g")])).collect()
    assert sorted(r["doc_id"] for r in twice) == [1, 2]


def test_depth():
    """Levels are taken off until the target is reached, by what was measured and by what is expected."""
    for trees in (8, 32, 64):
        k, _ = jaccard_join.matched_prefix({}, 0.8, trees, 20, 0.999)
        assert jaccard_join.chance(0.8, k, trees) >= 0.999 > jaccard_join.chance(0.8, k + 1, trees)
    many = {12: 50_000, 9: 40_000, 8: 9_990, 7: 8, 3: 2}
    assert jaccard_join.matched_prefix(many, 0.8, 32, 12, 0.9999) == (7, 1 - 2 / 100_000)  # deeper than expectation alone allows
    assert jaccard_join.matched_prefix({12: 90_000, 4: 10_000}, 0.8, 32, 12, 0.9999)[0] == 4  # measured losses count
    with pytest.raises(ValueError):
        jaccard_join.matched_prefix({}, 0.5, 2, 12, 0.9999)


def test_planted_pairs():
    for n in (*range(1, 40), 100, 1000, 12345):
        s = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
        p = jaccard_join.planted(s, Fraction(4, 5))
        if p is None:
            assert n < 5
            continue
        common = len(np.intersect1d(s, p))
        assert 0.8 <= common / (len(s) + len(p) - common) < (0.8 + 2.5 / n if n > 9 else 1)


def test_measured_recall(spark, small):
    """The recall measured on planted pairs agrees with what chance predicts, and the prefix that is matched reaches the target."""
    signed = jaccard_join.signatures(spark.read.parquet(f"{small}/documents.parquet")).cache()
    met = jaccard_join.measured_prefixes(signed)
    depth, recall = jaccard_join.matched_prefix(met, 0.8, jaccard_join.TREES, jaccard_join.DEEPEST, jaccard_join.RECALL)
    assert recall >= 0.99 and depth >= 5 and sum(met.values()) > 5


def test_templated_texts(make_docs, monkeypatch):
    """Texts that share most of their words, no two of them at the threshold, meet in tries, but none is moved to be compared."""
    template = words(50, 200, 5000)
    rng = random.Random(9)
    rows = [(i, " ".join(template[:130] + [f"own{i}x{k}" for k in range(80)] + template[130:])) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " more words") for i in range(0, 300, 60)]
    rng.shuffle(rows)
    moved = []
    real = jaccard_join._dealt
    monkeypatch.setattr(jaccard_join, "_dealt", lambda groups, size, key: moved.append((key, groups.count())) or real(groups, size, key))
    assert got(jaccard_join.jaccard_join(make_docs(rows))) == brute(rows)
    assert dict(moved)["component"] == 10


def test_sketches_in_blocks(make_docs, monkeypatch):
    """Nodes of unlike members are compared in blocks; no link is lost however small the blocks are."""
    template = words(51, 150, 5000)
    rows = [(i, " ".join(template + [f"own{i // 3}x{k}" for k in range(60)] + [f"e{i}"] * (i % 3))) for i in range(150)]
    want = brute(rows)
    for size in (4, 40):
        monkeypatch.setattr(jaccard_join, "SKETCHES", size)
        assert got(jaccard_join.jaccard_join(make_docs(rows))) == want


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(150)] + [(7, k) for k in range(8, 60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
