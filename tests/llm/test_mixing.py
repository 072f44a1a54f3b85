import random

import numpy as np
import pytest

from peptaflow.llm.mixing import fit_rates, mix, rated, replay
from peptaflow.llm.token_counts import load_pieces


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers

    return load_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_rates_meet_feasible_targets_and_agree_with_plain_descent(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 2000)
    n = rng.integers(1, 3000, 2000)
    members = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p, strict=True))], "id long, tokens long, p array<double>").repartition(5)
    steps, trace = fit_rates(members, [0.7, 0.2, 0.1], tolerance=1e-6)
    r = replay(p, steps)
    got = (n * r) @ p
    assert (r >= 0).all()
    assert np.allclose(got / n.sum(), [0.7, 0.2, 0.1], atol=1e-5)
    assert len(trace) == len(steps) + 1
    inverse = np.linalg.inv((p * n[:, None]).T @ p)
    own = np.ones(2000)
    for _ in range(len(steps)):
        own = np.maximum(0, own - p @ (inverse @ ((n * own) @ p - np.array([0.7, 0.2, 0.1]) * n.sum())))
    assert np.allclose(own, r, atol=1e-5)
    out = rated(members, steps)
    assert abs(out.selectExpr("avg(copies)").first()[0] - r.mean()) < 0.05
    assert out.filter("copies < floor(rate) OR copies > ceil(rate)").count() == 0


def test_mixture_of_labelled_corpus(tiny, spark, pieces, awkward):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(900):
        kind = "clean" if i % 3 else "low"
        text = " ".join(rng.choices([f"word{k}" for k in range(50)], k=60)) if kind == "clean" else " ".join(w.upper() + "!!" for w in rng.choices([f"word{k}" for k in range(50)], k=60))
        docs.append((i, text))
        labels.append((i, kind))
    targets = {"clean": 0.9, "low": 0.1, "toxic": 0.0}
    out = mix(tiny(docs + [(i, t) for i, t in awkward if i is None or i > 1000] + [(5000, None), (5001, "")]), spark.createDataFrame(labels, "id long, domain string"), pieces, targets, carry=True)
    rows = out.collect()
    assert len(rows) == len(docs) + 3 and all(r["rate"] >= 0 for r in rows)
    got = sum(r["tokens"] * r["rate"] * r["p_clean"] for r in rows) / sum(r["tokens"] * r["rate"] for r in rows)
    assert abs(got - 0.9) < 0.01
    assert np.mean([(r["p_clean"] > 0.5) == (r["doc_id"] % 3 != 0) for r in rows if r["doc_id"] is not None and r["doc_id"] < 900]) > 0.98
    assert out.select("row.*").columns == ["doc_id", "text", "lang", "source", "n_chars", "keep_id", "kept", "g"]


def test_empty_and_unlabelled(tiny, spark, pieces):
    none = spark.createDataFrame([], "id long, domain string")
    assert mix(tiny([(1, "x")]).limit(0), none, pieces).collect() == []
    assert mix(tiny([(1, "x y")]), none, pieces).first()["rate"] >= 0


def test_terms_of_raw_words():
    from peptaflow.llm.mixing import RawTerms
    from peptaflow.llm.toxicity import TermIds

    vocabulary = {t: i for i, t in enumerate(["alp-", "alpha", "alph-", "be", "gam-", "gamm-", "gamma", "élan", "éla-", "12", "123-"])}
    raw, plain = RawTerms(vocabulary), TermIds(vocabulary)
    for text in ["alpha", "Alpha,", "alphabet.", "be", "BE!!", "bee", "gamma-alpha", "gam", "ÉLAN", "élans", "12", "1234", "12-123", "", "--", "(alpha),", "alpha_", "_alpha.", "\"gamma's\"", "..be"]:
        import re

        assert set(raw.find(text)) == {i for w in re.findall(r"\w+", text.lower()) for i in plain[w]}, text


def test_posteriors_and_tokens_like_brute_force(tiny, spark, pieces):
    """Terms, softmax fit, posteriors, tokens and the reported gap are recomputed from the texts."""
    import re
    from collections import Counter

    from peptaflow.llm.mixing import fit_domains, memberships

    rng = random.Random(6)
    long = "q" * 80
    docs, labels = [], {}
    for i in range(300):
        low = i % 4 == 0
        words = rng.choices([f"Word{k}" for k in range(30)], k=20) + (rng.choices(["junk!", long, "JUNKYARD"], k=3) if low else rng.choices(["fine", "finely"], k=2))
        docs.append((i, " ".join(words) + "\n"))
        if i % 3:
            labels[i] = "low" if low else "clean"
    docs += [(900, None), (901, ""), (902, "junk " * 3000)]
    df = tiny(docs)
    domains = ["clean", "low"]
    model = fit_domains(df, spark.createDataFrame(list(labels.items()) + [(5, None), (None, "low")], "id long, domain string"), domains, pieces)
    got = {r["id"]: r for r in memberships(df, model, pieces).collect()}

    def terms(text):
        return {t for w in re.findall(r"\w+", (text or "").lower()) for t in [w, *(w[:n] + "-" for n in range(3, 9) if n < len(w))]}

    texts, n, k = dict(docs), Counter(), {d: Counter() for d in domains}
    for i, d in labels.items():
        n.update(terms(texts[i]))
        k[d].update(terms(texts[i]))
    a = len(labels)
    size = Counter(labels.values())
    chi = lambda t, d: a * (k[d][t] * a - n[t] * size[d]) ** 2 / (n[t] * (a - n[t]) * size[d] * (a - size[d])) if n[t] < a else 0
    vocabulary = sorted(t for t in n if any(chi(t, d) >= 30 for d in domains))
    assert vocabulary == sorted(model.vocabulary) and long in vocabulary

    def form(text):
        words = (text or "").split()
        c, m = Counter(words), len(words)
        if not m:
            return [0.0] * 8
        marks = sum(text.count(x) for x in "|#*")
        return [np.log1p(m), sum(w.isupper() for w in words) / m, len(c) / m, max(c.values()) / m, marks / m, text.count("!") / m, len(text) / m / 10, text.count("\n") / m]

    ids = sorted(labels)
    shape = np.array([form(texts[i]) for i in ids])
    mean, scale = shape.mean(0), shape.std(0) + 1e-6
    x = lambda i: np.concatenate([np.clip((np.array(form(texts[i])) - mean) / scale, -5, 5), [float(t in terms(texts[i])) for t in vocabulary], [1.0]])
    rows, hot = np.array([x(i) for i in ids]), np.eye(2)[[domains.index(labels[i]) for i in ids]]

    def loss(w):
        z = rows @ w
        z -= z.max(1, keepdims=True)
        return float(-(hot * (z - np.log(np.exp(z).sum(1, keepdims=True)))).sum() / len(rows) + 0.0005 * (w**2).sum())

    w = np.zeros((rows.shape[1], 2))
    for _ in range(4000):  # plain descent to the same optimum
        z = rows @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 0.15 * (rows.T @ (p - hot) / len(rows) + 0.001 * w)
    assert loss(model.weights) <= loss(w) + 1e-3
    known, longest = set(pieces), max(map(len, pieces))

    def slow_count(text):
        n = 0
        while text:
            size = next((m for m in range(min(len(text), longest), 0, -1) if text[:m] in known), 0)
            n += 1 if size else len(text[0].encode())
            text = text[size or 1 :]
        return n

    for i, text in docs:
        z = x(i) @ model.weights
        p = np.exp(z - z.max())
        assert np.allclose(got[i]["p"], p / p.sum(), atol=1e-9)
        assert got[i]["tokens"] == sum(slow_count("\u2581" + word) for word in (text or "").split())
    out = mix(df, spark.createDataFrame(list(labels.items()), "id long, domain string"), pieces, {"clean": 0.6, "low": 0.4}).collect()
    reached = np.array([[r["tokens"] * r["rate"] * r["p_clean"], r["tokens"] * r["rate"] * r["p_low"]] for r in out]).sum(0)
    assert all(abs(r["target_gap"] - np.abs(reached / reached.sum() - [0.6, 0.4]).max()) < 1e-9 for r in out) and out[0]["target_gap"] <= 2e-3


def test_domains_that_are_only_lowered(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([5, 0.2], 1000)
    members = spark.createDataFrame([(i, 10, b.tolist()) for i, b in enumerate(p)], "id long, tokens long, p array<double>")
    steps, trace = fit_rates(members, [0.5, 0.5], lowered=[1])
    assert len(steps) == 0 and np.allclose(trace[0]["goal"], p.mean(0))
    steps, trace = fit_rates(members, [0.99, 0.01], lowered=[1])
    assert len(steps) and np.allclose(trace[0]["goal"], [0.99, 0.01])


def test_words_as_python_splits_them():
    import sys

    import pyarrow as pa

    from peptaflow.llm.mixing import chunks, split_words

    texts = ["", " ", "a", " a\nb  a ", "\u3000x\x85y\x1cz ", "".join(f"a{chr(c)}" for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)]
    n, at, known = split_words(pa.array(texts))
    assert n.tolist() == [len(t.split()) for t in texts]
    assert [known[i] for i in at.tolist()] == [w for t in texts for w in t.split()]
    assert [c.to_pylist() for c in chunks(pa.array(["ab", None, "abcdef", "a", "b"]), 3)] == [["ab", ""], ["abcdef"], ["a", "b"]]
