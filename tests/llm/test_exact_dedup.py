import hashlib
import re
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from peptaflow.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = min(ids, key=lambda x: (x is not None, x or 0))
        for n, i in enumerate(sorted(ids, key=lambda x: (x is not None, x or 0))):
            out.append((i, keep, len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()], key=str)


@pytest.mark.parametrize("widths", [(64, 4096, 65536), (1, 2), (3,)])
def test_awkward_rows(tiny, awkward, widths):
    rows = [(i, t) for i, t in awkward if widths[0] > 3 or len(t or "") < 60]
    assert got(exact_dedup(tiny(rows), widths=widths)) == brute(rows)


def test_hot_group_and_carry(tiny):
    rows = [(i, "same text " * 50) for i in range(300)] + [(1000 + i, f"same text {i}") for i in range(50)]
    df = exact_dedup(tiny(rows), carry=True)
    assert got(df) == brute(rows)
    kept = df.filter("kept").select("row.*")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "keep_id", "kept", "g"]
    assert kept.count() == 51 and kept.filter("text IS NULL").count() == 0


def test_same_id_in_two_groups(tiny):
    rows = [(7, "aa" * 40 + "x" * 30), (8, "aa" * 40 + "x" * 30), (7, "bb" * 40 + "x" * 30), (9, "bb" * 40 + "x" * 30)]
    assert got(exact_dedup(tiny(rows), widths=(40, 8))) == brute(rows)


def test_empty_table(tiny):
    assert exact_dedup(tiny([(1, "x")]).limit(0)).collect() == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 20), st.one_of(st.none(), st.text("ab \t\n", max_size=9))), min_size=1, max_size=30))
def test_like_brute_force(tiny, rows):
    assert got(exact_dedup(tiny(rows, 2), widths=(2, 3))) == brute(rows)
