from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from sparseloom.llm.quality import BASE, RULES, STANDARD, Policy, ablations, apply_policy, ledger, repeated_words


def brute_repeats(words, n=5):
    grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return len({j for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for j in range(i, i + n)})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), max_size=5))
def test_repeated_words(texts):
    assert repeated_words(texts).tolist() == [brute_repeats(t) for t in texts]


def test_policies_and_ablations(make_docs, edges):
    rows = edges + [(20 + i, " ".join(f"word{k}" for k in range(i, i + 12))) for i in range(5)] + [(40, "LOUD WORDS ONLY " * 5), (41, "### $$$ %%% " * 10)]
    entries = ledger(make_docs(rows)).collect()
    assert len(entries) == len(rows)
    judged = apply_policy(ledger(make_docs(rows)), STANDARD).collect()
    assert all(r["kept"] == (r["fail_bits"] == 0) and r["policy_version"] == 1 for r in judged)
    assert {r["doc_id"] for r in judged if r["kept"]} >= {20, 21, 22, 23, 24}
    for policy in (STANDARD, BASE, Policy("one", 3, ("symbols",))):
        got = {r["rule"]: (r["n_failed"], r["n_regained"], r["n_kept"]) for r in ablations(ledger(make_docs(rows)), policy).collect()}
        bits = [r["fail_bits"] & policy.mask for r in entries]
        want = {r.name: (sum(b >> r.bit & 1 for b in bits), sum(b == 1 << r.bit for b in bits), sum(b & ~(1 << r.bit) == 0 for b in bits)) for r in RULES if r.name in policy.rules}
        assert got == want
