"""URL filtering by host rules, then by exact membership in a Bloom filter cascade.

Level 1 encodes the listed names; every key of the corpus is tested against it, and only those that
pass are looked up in the list. Level 2 encodes level 1's false positives over the corpus's complete
set of keys; level 3 encodes level 2's false positives among the listed keys, and so on until a level
has none. A key of the corpus is listed or not according to the parity of the first level that lacks
it, so membership is exact though only bit arrays are shipped and no page is joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

#: (verdict, host, path prefix). A rule fits its host and all subdomains; the longest fitting one wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Labels of a listed name in the registered query.
NAME_LABELS = 3

#: Most bits of a cascade that are broadcast at once; larger cascades are split by key hash and applied in passes.
BROADCAST_BITS = 1 << 27
#: After so many levels the few keys left (equal 128-bit hashes) are kept as an exact list.
MAX_LEVELS = 48
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def suffix(host: Column, labels: int) -> Column:
    """The last ``labels`` labels of a host; the host itself if it has no more."""
    return F.substring_index(host, ".", -labels)


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int, k: int, bits: int) -> np.ndarray:
    """k bit positions of each key at a level (rows: probes)."""
    with np.errstate(over="ignore"):
        x = h1 + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        step = h2 | np.uint64(1)
        return np.stack([(x + np.uint64(i) * step) % np.uint64(bits) for i in range(k)])


class Cascade:
    """The bit arrays of one shard, lowest level first, and the exact leftovers."""

    def __init__(self, levels: list[tuple[int, int, np.ndarray]], leftovers: frozenset[str] = frozenset()):
        self.levels, self.leftovers = levels, leftovers

    def listed(self, h1: np.ndarray, h2: np.ndarray, keys: Sequence[str | None]) -> np.ndarray:
        alive, out = np.ones(len(h1), bool), np.zeros(len(h1), bool)
        for i, (bits, k, words) in enumerate(self.levels):
            at = np.flatnonzero(alive)
            if not len(at):
                break
            pos = _mixed(h1[at], h2[at], i, k, bits)
            hit = ((words[(pos >> np.uint64(6)).astype(np.int64)] >> (pos & np.uint64(63))) & np.uint64(1)).astype(bool).all(0)
            out[at[~hit]] = i % 2 == 1
            alive[at[~hit]] = False
        at = np.flatnonzero(alive)
        out[at] = [keys[j] in self.leftovers for j in at] if self.leftovers else len(self.levels) % 2 == 1
        return out


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit("second")).alias("h2")]


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64)


def _level_bits(keys: DataFrame, level: int, bits: int, k: int) -> np.ndarray:
    """One level's array: positions are grouped by machine word, each word's bits joined map-side first."""

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos = _mixed(_unsigned(b, "h1"), _unsigned(b, "h2"), level, k, bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((pos >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (pos & np.uint64(63))).view(np.int64))], names=["w", "b"])

    out = np.zeros((bits + 63) // 64, np.uint64)
    got = keys.select("h1", "h2").mapInArrow(words, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most bits/64 rows; the caller bounds bits
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def _passing(keys: DataFrame, level: int, bits: int, k: int, words: np.ndarray) -> DataFrame:
    """The keys (key, h1, h2) whose bits of a level are all set, written."""
    shared = keys.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos = _mixed(_unsigned(b, "h1"), _unsigned(b, "h2"), level, k, bits)
            hit = ((shared.value[(pos >> np.uint64(6)).astype(np.int64)] >> (pos & np.uint64(63))) & np.uint64(1)).astype(bool).all(0)
            yield b.filter(pa.array(hit))

    return written(keys.select("key", "h1", "h2").mapInArrow(run, "key string, h1 long, h2 long"), "cascade")


def build_cascade(names: DataFrame, keys: DataFrame) -> Cascade:
    """``names``: the list; ``keys``: the corpus's complete universe; both (key string, h1, h2 long), each key once."""
    count, others, levels, temps = names.count(), keys.count(), [], []
    encode, test = names, keys
    while count and len(levels) < MAX_LEVELS:
        p = min(0.5, max(math.sqrt(0.5) * count / max(others, 1), 2.0**-40)) if not levels else 0.5
        bits, k = max(64, math.ceil(-count * math.log(p) / math.log(2) ** 2)), max(1, round(-math.log2(p)))
        words = _level_bits(encode, len(levels), bits, k)
        levels.append((bits, k, words))
        false = _passing(test, len(levels) - 1, bits, k, words)
        temps.append(false)
        if len(levels) == 1:  # the hits alone are looked up
            met = false.join(names.select(F.col("key").alias("name")), F.col("key") == F.col("name"), "left").withColumn("on", F.col("name").isNotNull())
            hits = written(met.select("key", "h1", "h2", "on"), "cascade-hits")
            temps.append(hits)
            encode, test = hits.filter("NOT on").drop("on"), hits.filter("on").drop("on")
            count, others = encode.count(), test.count()
        else:
            encode, test, count, others = false, encode, false.count(), count
    leftovers = frozenset()
    if count:  # never seen: two keys of the universe share 128 bits of hash
        leftovers = frozenset(r["key"] for r in (encode if len(levels) % 2 == 0 else test).select("key").collect())
    discard(*temps)
    return Cascade(levels, leftovers)


def url_filter(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    ``listed``: one string column of names; a host is listed if it or a parent domain is among them.
    Null urls and urls without ``://`` have empty host and path; no rule fits them and the empty host is
    not listed unless ``listed`` holds an empty name. Repeated pages are judged alike; nulls and repeats in
    ``listed`` are ignored; an empty list blocks nothing; an empty table gives an empty result; other columns
    are not read. A very long host is read whole; only its last labels, as many as listed names have, are keys.

    Scale: a page is never joined; only distinct keys are shuffled (a hot host is combined map-side), and only
    those that pass level 1 are looked up. A cascade is broadcast when its bits fit ``broadcast_bits``; else
    the keys are split by hash and one pass over the judged pages is made per shard.
    """
    base = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url")).select("id", url_host(F.col("url")).alias("key"), url_path(F.col("url")).alias("path"))
    named = written(listed.select(F.col(listed.columns[0]).cast("string").alias("key")).filter("key IS NOT NULL").distinct().select("key", *_hashes(F.col("key"))), "url-names")
    labels = sorted(r["n"] for r in named.select(F.size(F.split("key", r"\.")).alias("n")).distinct().collect())
    own = [suffix(F.col("key"), n) for n in labels] or [F.col("key")]
    keys = written(base.select("key").distinct().select(F.explode(F.array_distinct(F.array(*own))).alias("key")).distinct().select("key", *_hashes(F.col("key"))), "url-keys")
    n_listed, n_all = named.count(), keys.count()
    worst = 3 * n_listed + n_listed * max(0.0, math.log2(max(n_all, 1) / max(n_listed, 1))) * 1.45 + 1024
    shards = max(1, math.ceil(worst / broadcast_bits))
    kind = dict(base.dtypes)["id"]

    judged, of = base.withColumn("listed", F.lit(False)), lambda df, s: df.filter(F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)) == s) if shards > 1 else df
    for s in range(shards):
        cascade = base.sparkSession.sparkContext.broadcast(build_cascade(of(named, s), of(keys, s)))

        def member(batches: Iterable[pa.RecordBatch], cascade=cascade) -> Iterator[pa.RecordBatch]:
            for b in batches:
                on = b.column("listed").to_numpy(zero_copy_only=False)
                for i, n in enumerate(labels):
                    names = [".".join(x.rsplit(".", n)[-n:]) for x in b.column("key").to_pylist()] if cascade.value.leftovers else []
                    mine = cascade.value.listed(_unsigned(b, f"a{i}"), _unsigned(b, f"b{i}"), names)
                    on = on | (mine & b.column(f"in{i}").to_numpy(zero_copy_only=False) if shards > 1 else mine)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), b.column("path"), pa.array(on)], names=["id", "key", "path", "listed"])

        hashes = [c for i, x in enumerate(own) for c in (F.xxhash64(x).alias(f"a{i}"), F.xxhash64(x, F.lit("second")).alias(f"b{i}"), *([(F.pmod(F.xxhash64(x, F.lit("shard")), F.lit(shards)) == s).alias(f"in{i}")] if shards > 1 else []))]
        new = judged.select("id", "key", "path", "listed", *hashes).mapInArrow(member, f"id {kind}, key string, path string, listed boolean")
        judged = written(new, "judged") if s < shards - 1 else new

    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    for what, host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("key") == host) | F.col("key").endswith("." + host)) & F.col("path").startswith(prefix)
        rule, verdict = F.when(fits, F.lit(host + prefix)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    discard(keys, named)
    return judged.select(F.col("id").alias(id_col), F.col("key").alias("host"), "path", rule.alias("rule"), verdict.alias("verdict"))


def plain_names(pages: DataFrame, url_col: str = "url", labels: int = NAME_LABELS) -> DataFrame:
    """Names (the last labels of hosts) of which more than half of the pages come without transport security: the list of the registered query."""
    url = F.col(f"`{url_col}`").cast("string")
    names = pages.select(suffix(url_host(url), labels).alias("name"), F.lower(url).startswith("http://").alias("plain")).filter("name <> ''")
    return names.groupBy("name").agg(F.avg(F.col("plain").cast("int")).alias("share")).filter("share > 0.5").select("name")


def op6_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages, plain_names(pages))


_FIT = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_LONGEST = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
ORACLE = f"""
WITH p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), '{_UPPER}', '{_LOWER}') AS host,
  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
listed AS (SELECT array_to_string(string_split(host, '.')[-{NAME_LABELS}:], '.') AS name FROM p WHERE host <> ''
  GROUP BY 1 HAVING avg(CASE WHEN starts_with(lower(url), 'http://') THEN 1.0 ELSE 0 END) > 0.5),
h AS (SELECT host, bool_or(name IS NOT NULL) AS on_list FROM (SELECT DISTINCT host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM p) x
  LEFT JOIN listed ON name = array_to_string(string_split(host, '.')[-i:], '.') GROUP BY host)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_FIT.format(h=h, p=p)} THEN '{h}{p}'" for _, h, p in _LONGEST)} END AS rule,
  CASE {" ".join(f"WHEN {_FIT.format(h=h, p=p)} THEN '{v}'" for v, h, p in _LONGEST)} WHEN on_list THEN 'block' ELSE 'allow' END AS verdict
FROM p JOIN h USING (host)"""
