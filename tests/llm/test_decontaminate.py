import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparseloom.llm import decontaminate
from sparseloom.llm.decontaminate import COVERAGE, SEED, find_leaks, flag_documents, held_words, seeds_of, telling_seeds, tiles, words_of
from tests.llm.conftest import words


def brute_tiles(item, text, least):
    """Longest common runs of unmarked words, marked one by one."""
    used_i, used_t, found = [False] * len(item), [False] * len(text), []
    least = max(1, min(least, len(item)))
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and not used_i[i + n] and not used_t[j + n] and item[i + n] == text[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return found
        for k in range(n):
            used_i[i + k] = used_t[j + k] = True
        found.append((i, j, n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=14), st.lists(st.integers(1, 4), max_size=30), st.integers(1, 4))
def test_tiles(item, text, least):
    a, b = np.array(item, np.uint64), np.array(text, np.uint64)
    assert tiles(a, [b] if len(b) else [], least) == brute_tiles(item, text, least)


def test_leaks(spark, make_docs, edges):
    item = words(1, 40)
    other = words(2, 30)
    text = lambda *parts: " ".join(w for p in parts for w in p)
    rows = edges + [
        (20, text(words(3, 200), item, words(4, 100))),
        (21, text(words(5, 50), item[20:], words(6, 50), item[:20])),  # the halves in another order
        (22, text(words(7, 300))),
        (23, text(words(8, 20), item[:10], words(9, 20))),  # a quarter of it
        (24, text([w.upper() + "," for w in item])),
        (25, text(item[30:], item[15:30], other, item[:15])),
        (26, text(item)), (26, text(item)),
    ]
    benchmark = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(other)), (2, None), (3, "  "), (None, " ".join(item)), (4, "Àé naïve"), (0, " ".join(item))], "item_id long, text string").selectExpr("*", "0 AS doc_id", "'x' AS seed")
    leaks = find_leaks(make_docs(rows), benchmark)
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in leaks.collect()}
    assert set(got) == {(20, 0), (21, 0), (24, 0), (25, 0), (25, 1), (26, 0)} and all(c == 1 for c in got.values())
    flags = flag_documents(make_docs(rows), leaks).collect()
    assert len(flags) == len(rows) and {r["doc_id"] for r in flags if r["contaminated"]} == {20, 21, 24, 25, 26}
    assert next(r for r in flags if r["doc_id"] == 25)["n_items"] == 2


def test_short_items_and_empty_tables(spark, make_docs):
    benchmark = spark.createDataFrame([(7, "two words")], "item_id long, text string")
    docs = make_docs([(1, "here are Two Words, in a row"), (2, "two and words apart")])
    assert [(r["doc_id"], r["item_id"]) for r in find_leaks(docs, benchmark).collect()] == [(1, 7)]
    assert find_leaks(docs, benchmark.limit(0)).count() == 0 and find_leaks(docs.limit(0), benchmark).count() == 0


def test_brute_force_on_the_table(spark, small):
    """Documents that hold a whole item are found, and no others but those that hold most of one."""
    docs = {r["doc_id"]: " ".join(r["text"].split()) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r["item_id"]: " ".join(r["text"].split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    leaks = {(r["doc_id"], r["item_id"]) for r in find_leaks(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    # every pair with a common seed is tiled whole
    docs_w, items_w = ({k: words_of(t) for k, t in x.items()} for x in (docs, items))
    holders = {}
    for d, w in docs_w.items():
        for h in set(seeds_of(w, SEED).tolist()) | {int(x) for x in w}:
            holders.setdefault(h, set()).add(d)
    brute = set()
    for i, w in items_w.items():
        for d in set().union(*(holders.get(h, set()) for h in seeds_of(w, SEED).tolist())):
            if sum(n for _, _, n in tiles(w, [docs_w[d]], SEED)) / len(w) >= COVERAGE:
                brute.add((d, i))
    assert leaks == brute
    whole = {(d, i) for d, t in docs.items() for i, s in items.items() if s in t}
    assert whole <= leaks


def test_shared_templates(spark, make_docs):
    """Words that all items and many documents share make no pairs, and hide no leak."""
    rare = lambda seed, n: [f"r{x}" for x in np.random.default_rng(seed).integers(0, 100_000, n)]
    template = words(100, 12)
    items = [(i, " ".join(template + rare(1000 + i, 20 + i % 9))) for i in range(300)]
    docs = [(d, " ".join(template + rare(5000 + d, 60))) for d in range(500)]
    docs += [(1000 + i, " ".join(words(9, 30) + t.split()[16:] + words(8, 5) + t.split()[:16])) for i, t in items[::50]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(make_docs(docs), benchmark).collect()}
    assert got == {(1000 + i, i) for i, _ in items[::50]}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=14), st.lists(st.integers(1, 5), max_size=30), st.dictionaries(st.integers(0, 40), st.integers(1, 9)))
def test_telling_seeds_lose_nothing(item, text, heats):
    a, b = np.array(item, np.uint64), np.array(text, np.uint64)
    found = seeds_of(a, 3).view(np.int64)
    n = min(3, len(a))
    shared = set(seeds_of(b, n).view(np.int64).tolist()) if len(b) >= n else set()
    heat = {s: heats.get(k, 1) for k, s in enumerate(found.tolist())} | {s: 5 for s in shared & set(found.tolist())}
    if sum(m for _, _, m in tiles(a, [b] if len(b) else [], 3)) / len(a) >= 0.6:
        assert shared & set(telling_seeds(a, heat, 3, 0.6).tolist())


def test_one_very_long_text(spark, make_docs):
    item = words(11, 60)
    long = " ".join(words(12, 400_000, 50_000) + item[30:] + words(13, 100_000, 50_000) + item[:30])
    benchmark = spark.createDataFrame([(0, " ".join(item)), (1, "other words that the text does not hold at all")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["n_covered"]) for r in find_leaks(make_docs([(1, long), (2, "short")]), benchmark).collect()] == [(1, 0, 60)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=14), st.lists(st.integers(1, 5), max_size=40), st.integers(1, 4))
def test_places_are_enough(item, text, seed):
    """Tiles of the words at the places of shared seeds are those of the whole text."""
    a, b = np.array(item, np.uint64), np.array(text, np.uint64)
    n = min(seed, len(a))
    of_text = seeds_of(b, n) if len(b) >= n else np.zeros(0, np.uint64)
    shared = np.intersect1d(seeds_of(a, seed), of_text)
    whole = tiles(a, [b] if len(b) else [], seed)
    if not len(shared):
        assert not whole
        return
    got = tiles(a, held_words(a, n, shared.view(np.int64), [np.flatnonzero(of_text == s).tolist() for s in shared]), seed)
    assert [(i, k) for i, _, k in got] == [(i, k) for i, _, k in whole]


def test_document_with_the_whole_benchmark(spark, make_docs, monkeypatch):
    """What pairs carry grows with the items, not with items times the length of the document."""
    rare = lambda seed, n: [f"r{x}" for x in np.random.default_rng(seed).integers(0, 10**7, n)]
    carried = []
    real = decontaminate.met_places

    def spied(*tables):
        out = real(*tables)
        carried.append(out.select(F.explode("met").alias("m")).agg(F.sum(F.size("m.at"))).first()[0])
        return out

    monkeypatch.setattr(decontaminate, "met_places", spied)
    for n in (500, 2000):
        items = [(i, " ".join(rare(i, 40))) for i in range(n)]
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        docs = make_docs([(1, " ".join(t for _, t in items)), (2, " ".join(rare(10**6, 500))), (3, items[7][1])])
        leaks = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, benchmark).collect()}
        assert leaks == {(1, i) for i in range(n)} | {(3, 7)}
        assert carried[-1] == 36 * (n + 1)
