import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peptaflow.llm.token_counts import LongestMatch, WordCounts, load_pieces, token_counts


def greedy(text, pieces):
    n, longest = 0, max(map(len, pieces), default=0)
    while text:
        size = next((k for k in range(min(len(text), longest), 0, -1) if text[:k] in pieces), 0)
        n += 1 if size else len(text[0].encode())
        text = text[size or 1 :]
    return n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abcé", min_size=1, max_size=5), max_size=12), st.text("abcéz漢", max_size=30))
def test_automaton_equals_greedy(pieces, text):
    assert LongestMatch(pieces).count(text) == greedy(text, set(pieces))


@pytest.fixture(scope="module")
def real():
    import public_tokenizers

    return load_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_rows(tiny, awkward, real):
    out = {(r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts(tiny(awkward), real).collect()}
    known = set(real)
    memo = {w: greedy("▁" + w, known) for _, t in awkward for w in set((t or "").split())}
    want = {(i, len((t or "").split()), sum(memo[w] for w in (t or "").split())) for i, t in awkward}
    assert out == want


def test_cache_forgets():
    c = WordCounts(LongestMatch(["a"]), most=3)
    assert [c[w] for w in "a b c d e a".split()] and len(c) <= 3


def test_empty_table(tiny, real):
    assert token_counts(tiny([(1, "x")]).limit(0), real).collect() == []
