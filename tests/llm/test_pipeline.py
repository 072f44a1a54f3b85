import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from peptaflow.llm import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    good, bad = [f"plain{i}" for i in range(300)], ["scoundrel", "dolt", "vermin"]
    docs, labels = [], []
    for i in range(900):
        words = rng.choices(good, k=rng.randint(30, 80))
        if i % 9 == 0:
            for _ in range(5):
                words[rng.randrange(len(words))] = rng.choice(bad)
        if i % 10 == 0:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(i % 10 != 0), int(i % 9 == 0)))
    docs += [(1000 + i, docs[1][1].replace(" ", "  ")) for i in range(40)] + [(2000 + i, docs[2][1] + f" {w}") for i, w in enumerate(good[:20])] + [(3000, None), (3001, ""), (3002, "word " * 30_000), (3, docs[3][1]), (3, docs[3][1])]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


def test_each_stage_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    outs = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == COLUMNS
        outs.append((before, docs.collect()))

    before, rows = outs[0]
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=str) == [(i, t) for i, t in before if model.score(t or "")[0] < 0.5]
    toxic = {i for i, t in before if t and re.search("(?i)scoundrel|dolt|vermin", t)}
    kept = {r["doc_id"] for r in rows}
    assert len(toxic & kept) <= 0.1 * len(toxic) and len({i for i, _ in before} - toxic - kept) <= 5

    before, rows = outs[1]
    best = {}
    for i, t in before:
        key = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        best[key] = min(best.get(key, i), i)
    assert Counter(r["doc_id"] for r in rows) == Counter(best.values())

    before, rows = outs[2]
    grams = lambda t: {" ".join(w[k : k + 5]) for w in [(t or "").lower().split()] for k in range(max(1, len(w) - 4))}
    sets = {i: grams(t) for i, t in before}
    label = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for i in sets:
            for j in sets:
                if label[i] != label[j]:
                    both = len(sets[i] & sets[j])
                    if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                        label[i] = label[j] = min(label[i], label[j])
                        moved = True
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i in sets if label[i] == i)

    before, rows = outs[3]
    assert set((r["doc_id"], r["text"]) for r in rows) <= set(before)
    plain = {i for i, t in before if t and t != t.upper()}
    assert len({r["doc_id"] for r in rows} & plain) >= 0.97 * len(plain)
    tokens = lambda part: sum(len(t or "") for _, t in part)
    share = tokens((r["doc_id"], r["text"]) for r in rows if r["doc_id"] not in plain) / tokens((r["doc_id"], r["text"]) for r in rows)
    assert share < 0.16 < tokens((i, t) for i, t in before if i not in plain) / tokens(before) + 0.16

    before, rows = outs[4]
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(i for i, _ in before)
    assert all(r["offset"] + r["length"] <= 2048 for r in rows)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 300


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in names if re.match(r"op\d+_", n)] and {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
