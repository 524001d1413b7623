from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparseloom.llm.substring_dedup import remove_repeats
from tests.llm.conftest import words


def brute(rows, n):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + n]) for _, w in texts for k in range(len(w) - n + 1))
    out = []
    for i, w in texts:
        gone = {j for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
        out.append((str(i), b" ".join(x for j, x in enumerate(w) if j not in gone).decode(), len(w), len(gone)))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["text"], r["n_words"], r["n_removed"]) for r in df.collect())


def passages():
    p, q = words(1, 60, 3000), words(2, 41, 3000)
    text = lambda *parts: " ".join(w for x in parts for w in x)
    rows = [(k, text(words(10 + k, 30, 3000), p[k : k + 45], words(40 + k, 25, 3000))) for k in range(12)]
    rows += [(20, text(q, words(60, 9, 3000), q)), (21, text(q[:34], ["x"])), (22, text(["y"], q[3:38])), (23, " ".join(["a"] * 90)), (24, " ".join(["a", "b"] * 40)), (25, text(p[:20], q, p[20:60]))]
    return rows


@pytest.mark.parametrize("window", [12, 35, 50])
def test_passages(make_docs, edges, window):
    rows = passages() + edges
    assert got(remove_repeats(make_docs(rows), window)) == brute(rows, window)


def test_periodic_and_equal_rows(make_docs):
    rows = [(1, " ".join("abc"[k % 3] for k in range(200))), (2, " ".join(words(3, 80))), (2, " ".join(words(3, 80))), (3, " ".join("abcd"[k % 4] for k in range(37)))]
    assert got(remove_repeats(make_docs(rows))) == brute(rows, 35)


def test_spans(make_docs):
    q = [f"q{k}" for k in range(41)]
    rows = [(1, " ".join(q + [f"x{k}" for k in range(9)] + q)), (2, "one two three")]
    row = remove_repeats(make_docs(rows)).filter(F.col("doc_id") == 1).first()
    assert [(s["start"], s["end"]) for s in row["repeats"]] == [(0, 41), (50, 91)] and row["n_removed"] == 82


def test_hot_passage(make_docs):
    hot = words(5, 50, 9000)
    rows = [(k, " ".join(words(1000 + k, 20, 9000) + hot + words(5000 + k, 10, 9000))) for k in range(400)]
    assert got(remove_repeats(make_docs(rows))) == brute(rows, 35)
