import itertools
import random

import pytest

import corpus_pipeline
from peptaflow.llm import near_dedup, simhash
from peptaflow.llm.near_dedup import bands, near_components, shingles


def slow_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_components(rows):
    sets = [slow_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
            label = [label[i] if x == label[j] else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return [least.get(x) for x in label]


def edited(rng, words, edits):
    words = list(words)
    for k in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


def test_stage_drops_near_copies_that_simhash_keeps(spark, tiny):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited(rng, base, 2)))]
    pairs = [(rows[2 * i][1], rows[2 * i + 1][1]) for i in range(40)]
    assert sum(bin(simhash.fingerprint(a) ^ simhash.fingerprint(b)).count("1") > 3 for a, b in pairs) > 10
    left = corpus_pipeline.drop_near_copies(spark, tiny(rows), "")
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(0, 80, 2))


def test_repeated_ids_keep_their_texts(spark, tiny):
    a, other = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    rows = [(1, a), (5, a.replace("a99", "z")), (5, other), (5, other), (None, other + " end"), (None, None), (None, ""), (7, "  ")]
    left = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, tiny(rows), "").collect()), key=str)
    assert left == sorted([(1, a), (5, other), (7, "  ")], key=str)
    kept = near_components(tiny(rows)).filter("kept").collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in kept) == [(1, 1), (5, 5), (5, 5), (7, 7)]
    out = corpus_pipeline.drop_near_copies(spark, tiny(rows), "")
    assert out.columns == tiny(rows).columns and corpus_pipeline.drop_near_copies(spark, tiny(rows).limit(0), "").collect() == []


@pytest.mark.parametrize("part", [near_dedup.PART, 3])
def test_components_against_all_pairs(tiny, awkward, part, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART", part)
    rng = random.Random(8)
    rows = list(awkward)
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(100)]
        for k in range(25):  # a chain: neighbours are alike, its ends are not
            rows.append((100 * (g + 1) + k, " ".join(words)))
            words = edited(rng, words, rng.choice([1, 2, 3, 4]))
    core = [f"t{i}" for i in range(85)]  # a family just below the similarity, with one late pair above it
    rows += [(2000 + k, " ".join(core + [f"u{k}x{i}" for i in range(15)])) for k in range(40)] + [(2050, " ".join(core + [f"u7x{i}" for i in range(14)]))]
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_components(tiny(rows)).collect()), key=str)
    assert got == sorted(((i, c) for (i, _), c in zip(rows, slow_components(rows), strict=True)), key=str)
    assert near_components(tiny(rows).limit(0)).collect() == []


def test_bands_propose_pairs_of_similarity_four_fifths():
    rng = random.Random(2)
    for _ in range(200):
        common, a, b = ([f"{rng.random()}" for _ in range(n)] for n in (160, 20, 20))
        x, y = (shingles("\n".join(part), 1) for part in (common + a, common + b))
        assert (bands(x) == bands(y)).any()
