import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peptaflow.llm.packing import ChunkIds, load_ranks, pack, plan


@pytest.fixture(scope="module")
def own():
    return ChunkIds(*load_ranks(), most=50)


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXT = st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\u00a0\u3000'sdlmtrevABé1²½漢🙂_!?<|>"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_equal_the_tokenizer(own, reference, text):
    assert np.frombuffer(own.ids(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_special_strings_are_tokens(own, reference):
    assert np.frombuffer(own.ids("a<|endoftext|>b"), "<u4").tolist() == [64, 50256, 65]
    for text in ["a <|endoftext|> b  c \n", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "a  <|endoftext|>  b", "<|endoftext|", "\n<|endoftext|>\n\n <|endoftext|>s"]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), max_size=12))
def test_plan_places_every_rank_once(histogram):
    rows, n = plan(histogram, 32)
    used, ranks = defaultdict(list), Counter()
    for length, first, per, seq, offset in rows.tolist():
        nexts = [r[1] for r in rows.tolist() if r[0] == length and r[1] > first]
        upto = min(nexts, default=histogram[length])
        for r in range(first, upto):
            used[seq + (r - first) // per].append((offset + (r - first) % per * length, length))
            ranks[length, r] += 1
    assert ranks == Counter((size, r) for size, c in histogram.items() for r in range(c))
    assert set(used) == set(range(n))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    # best-fit decreasing, item by item
    free = []
    for size in sorted((s for s, c in histogram.items() for _ in range(c)), reverse=True):
        fit = min((f for f in free if f >= size), default=None)
        if fit is None:
            free.append(32 - size)
        else:
            free[free.index(fit)] -= size
    assert n == len(free)


def test_rows(tiny, awkward, own):
    rng = random.Random(2)
    rows = awkward + [(100 + i, " ".join(rng.choices(["alpha", "be", "gamma ray", "x1"], k=rng.randint(0, 900)))) for i in range(60)]
    out = [r.asDict() for r in pack(tiny(rows), *load_ranks()).collect()]
    want = []
    for i, t in rows:
        ids = own.ids(t or "") + bytes(4)
        n, at, k = len(ids) // 4, 0, 0
        size = n % 2048 or 2048
        while at < n:
            want.append((i, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
            at, k, size = at + size, k + 1, 2048
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=str) == sorted(want, key=str)
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in out)
    assert len(seqs) <= math.ceil(total / 2048) * 1.02 + 1


def test_empty_table(tiny):
    assert pack(tiny([(1, "x")]).limit(0), *load_ranks()).collect() == []
