from sparseloom.llm.line_dedup import line_dedup


def brute(rows, min_chars=10, min_docs=2):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or min(holders[key(x)]) == i]
        out.append((str(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect())


def test_edges(make_docs, edges):
    assert got(line_dedup(make_docs(edges))) == brute(edges)


def test_thresholds(make_docs):
    rows = [(i, f"shared by all\nby evens {i % 2}\nown line {i}\nshort") for i in range(8)]
    for least in (1, 2, 5):
        assert got(line_dedup(make_docs(rows), min_docs=least)) == brute(rows, min_docs=least)
    assert got(line_dedup(make_docs(rows), min_chars=3)) == brute(rows, min_chars=3)


def test_one_id_with_two_texts(make_docs):
    rows = [(1, "a line of its own\nx"), (1, "a line of its own\ny"), (2, "A line of its own")]
    assert got(line_dedup(make_docs(rows))) == brute(rows)


def test_carried_columns(make_docs):
    row = line_dedup(make_docs([(1, "text")]), carry=("source", "line")).first()
    assert row["carried"].asDict() == {"source": "src", "line": 7}


def test_hot_line_and_long_text(make_docs):
    rows = [(i, "the very same hot line\n" + f"line number {i} of its kind") for i in range(3000)] + [(5000, "\n".join(f"one of many lines {k % 1500}" for k in range(3000)))]
    assert got(line_dedup(make_docs(rows))) == brute(rows)
