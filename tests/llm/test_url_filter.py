import pytest

from peptaflow.llm.url_filter import RULES, Cascade, build_cascade, plain_names, url_filter


def judge(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if fit:
        v, h, p = max(fit, key=lambda r: len(r[1] + r[2]))
        return host, path, h + p, v
    names = [".".join(host.split(".")[i:]) for i in range(host.count(".") + 1)]
    return host, path, None, "block" if any(n in listed for n in names) else "allow"


URLS = [None, "", "nothing", "http://", "https://Spam.Example.NET/a?b#c", "http://spam.example.net", "x://a.spam.example.net?q=/", "http://example.org/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://org", "http://org/", "http://a.com/fr/1", "http://a.com/de/", "http://a.com/en", "http://notspam.example.net/", "ftp://e.net#x://y", "http://É.net/ß", "http://bad.net/\nx"]


@pytest.mark.parametrize("bits", [1 << 29, 64])
def test_rows(spark, bits):
    rows = [(i, u, "html") for i, u in enumerate(URLS * 3)] + [(900 + i, f"http://h{i}.net/p", None) for i in range(300)] + [(None, "http://bad.net/", "")]
    listed = {"spam.example.net", "bad.net"} | {f"h{i}.net" for i in range(0, 300, 7)}
    pages = spark.createDataFrame(rows, "page_id long, url string, listed string").repartition(5)
    names = spark.createDataFrame([(n,) for n in listed] + [(None,), ("bad.net",)], "key string")
    out = sorted((tuple(r) for r in url_filter(pages, names, broadcast_bits=bits if bits > 64 else 600).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert out == sorted(((i, *judge(u, listed)) for i, u, _ in rows), key=str)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    names = spark.createDataFrame([], "name string")
    assert url_filter(pages, names).collect() == []
    one = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    assert url_filter(one, names).first()["verdict"] == "allow"


def test_cascade_is_exact_over_its_universe(spark):
    from peptaflow.llm.url_filter import _hashes, _unsigned
    from pyspark.sql import functions as F

    keys = spark.range(4000).select(F.col("id").cast("string").alias("key")).select("key", *_hashes(F.col("key")))
    names = spark.range(0, 9000, 5).select(F.col("id").cast("string").alias("key")).select("key", *_hashes(F.col("key")))
    cascade = build_cascade(names, keys)
    assert isinstance(cascade, Cascade) and len(cascade.levels) > 1
    t = keys.toArrow().combine_chunks().to_batches()[0]
    assert cascade.listed(_unsigned(t, "h1"), _unsigned(t, "h2"), []).tolist() == [int(k) % 5 == 0 for k in t.column("key").to_pylist()]


def test_long_hosts_and_deep_names(spark):
    long = ".".join(["a"] * 20_000)
    rows = [(1, f"http://{long}.bad.example.net/"), (2, f"http://{long}/"), (3, "http://example.net/"), (4, "http://x.y.z.deep.name.of.many.labels/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    names = spark.createDataFrame([("bad.example.net",), ("deep.name.of.many.labels",), ("a.a.a.a",)], "name string")
    for bits in (1 << 29, 500):
        assert {r["page_id"]: r["verdict"] for r in url_filter(pages, names, broadcast_bits=bits).collect()} == {1: "block", 2: "block", 3: "allow", 4: "block"}


def test_list_of_the_query(spark):
    rows = [(1, "http://a.b.example.com/"), (2, "HTTP://c.b.example.com/"), (3, "https://b.example.com/"), (4, "https://q.example.org/"), (5, "http://q.example.org/"), (6, None), (7, "nothing")]
    got = plain_names(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert [r["name"] for r in got] == ["b.example.com"]
