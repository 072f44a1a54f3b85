import itertools
import random
import re

import pytest
import xxhash

from peptaflow.llm.simhash import DEPTH, HEAVY, components, fingerprint, links, masks, simhash_components


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_components(pairs):
    label = {fp: fp for _, fp in pairs}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(label, 2):
            if bin(a ^ b).count("1") <= 3 and label[a] != label[b]:
                lo = min(label[a], label[b])
                label[a] = label[b] = lo
                changed = True
    least = {}
    for i, fp in pairs:
        if i is not None:
            least[label[fp]] = min(least.get(label[fp], i), i)
    return [least.get(label[fp]) for _, fp in pairs]


def test_fingerprint(awkward):
    for _, t in awkward:
        assert fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(depth):
    found = masks(depth)
    assert len(found) == 15
    for bits in itertools.combinations(range(64), 3):
        d = sum(1 << b for b in bits)
        assert any(not m & d for m in found)


@pytest.mark.parametrize("heavy", [1024, 3])
def test_links_connect_like_all_pairs(spark, heavy):
    rng = random.Random(5)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f), i) for i, f in enumerate(sorted(fps))], "fp long, rank long")
    edges = links(df.select("fp"), heavy=heavy)
    for r in edges.collect():
        assert bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 3
    labels = {r["node"] & (2**64 - 1): r["label"] for r in components(df.selectExpr("fp AS node", "rank"), edges).collect()}
    want = slow_components([(i, f) for i, f in enumerate(sorted(fps))])
    assert [labels.get(f, i) for i, f in enumerate(sorted(fps))] == want


def test_rows(tiny, awkward):
    base = " ".join(f"word{i}" for i in range(400))
    rows = awkward + [(100, base), (101, base.replace("word7 ", "other ")), (102, base.upper())] + [(200 + i, base) for i in range(80)]
    out = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_components(tiny(rows)).collect()), key=str)
    fps = [slow_fingerprint(t) for _, t in rows]
    want = slow_components([(i, f) for (i, _), f in zip(rows, fps, strict=True)])
    assert out == sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, want, strict=True)), key=str)


def test_empty_table(tiny):
    assert simhash_components(tiny([(1, "x")]).limit(0)).collect() == []


def test_last_buckets_are_small():
    """Positions that are kept by none of one mask of each covering bound a bucket's distinct fingerprints."""
    free = {(1 << 64) - 1}
    for depth in range(DEPTH):
        free = {f & ~m for f in free for m in masks(depth)}
    assert max(bin(f).count("1") for f in free) <= 9 and 2**9 <= HEAVY


def test_dense_ball_of_fingerprints(spark):
    """Thousands of fingerprints of one bucket: all coverings are used and all are joined."""
    center = random.Random(7).getrandbits(64)
    fps = {center} | {center ^ sum(1 << b for b in c) for n in (1, 2) for c in itertools.combinations(range(64), n)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f), i) for i, f in enumerate(sorted(fps))], "fp long, rank long")
    labels = components(df.selectExpr("fp AS node", "rank"), links(df.select("fp"), heavy=100)).collect()
    assert len(labels) == len(fps) and {r["label"] for r in labels} == {0}


def test_null_ids_beside_near_texts(tiny):
    a = " ".join(f"word{i}" for i in range(400))
    b = next(t for i in range(400) if 0 < bin(slow_fingerprint(t := a.replace(f"word{i} ", f"x{i} ")) ^ slow_fingerprint(a)).count("1") <= 3)
    out = simhash_components(tiny([(None, a), (5, b), (9, b), (None, "alone")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(None, 5), (5, 5), (9, 5), (None, None)}
