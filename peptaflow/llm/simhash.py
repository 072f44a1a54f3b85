"""SimHash near-duplicates found by covering locality-sensitive hashing.

Every bit position gets a vector of ``radius + 1`` bits, and each non-zero vector v gives one
table whose mask keeps the positions with an odd inner product with v. The positions in which
two fingerprints within the radius differ span at most ``radius`` dimensions, so some v is
orthogonal to all of them: that table's mask keeps none of them and the pair collides there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Buckets with more fingerprints are refined by the masks of another covering. Fingerprints of one bucket differ only in
#: positions that no mask on its way kept: after DEPTH coverings 9 at most (for RADIUS), so none holds more than 512.
HEAVY, DEPTH = 1024, 4
#: Seed of the order of positions in coverings after the first, chosen for that bound.
TURNS = 26


def gram_hashes(text: str | bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; A-Z lower-cased, words split at ASCII white space. Fewer words than a shingle are hashed as a whole; without words there is no hash."""
    words = (text or b"" if not isinstance(text, str) else text.encode("utf-8", "surrogatepass")).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        grams: Iterable[bytes] = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, seed) for g in grams), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of word shingles; zero without words."""
    return majority(gram_hashes(text, shingle, seed))


def masks(depth: int = 0, radius: int = RADIUS) -> list[int]:
    """Masks of one covering; other depths assign the same vectors to other positions."""
    size, rng = 1 << (radius + 1), np.random.default_rng(TURNS)
    vectors = 1 + np.arange(BITS) % (size - 1)
    for d in range(depth):
        vectors = rng.permutation(1 + np.arange(BITS) % (size - 1))
    return [sum(1 << i for i in range(BITS) if bin(int(vectors[i]) & v).count("1") % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long) for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, fp long")


def _forest(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets (equal adjacent keys) that connect all that are linked: a spanning forest for each bucket."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (p := parent.get(i, i)) != i:
            parent[i] = i = parent.get(p, p)
        return i

    a, b, n, gap = [], [], len(fps), 1
    alive = np.flatnonzero(keys[:-1] == keys[1:]) if n > 1 else np.zeros(0, np.int64)
    while len(alive):
        near = np.bitwise_count(fps[alive] ^ fps[alive + gap]) <= radius
        for i in alive[near].tolist():
            x, y = root(i), root(i + gap)
            if x != y:
                parent[max(x, y)] = min(x, y)
                a.append(i)
                b.append(i + gap)
        gap += 1
        alive = alive[alive + gap < n]
        alive = alive[keys[alive] == keys[alive + gap]]
    return np.array(a, np.int64), np.array(b, np.int64)


def _verify(radius: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = _forest(k, f.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(f[a]), pa.array(f[b])], names=["a", "b"])

        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column("bucket").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
            if cut:
                yield linked(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        yield linked(keys, fps)

    return run


def links(distinct: DataFrame, radius: int = RADIUS, heavy: int = HEAVY) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) at ``radius`` or fewer differing bits, enough to connect all that are linked.

    Buckets are first counted map-side; only those with two or more fingerprints are dealt out. A bucket
    over ``heavy`` is refined by another covering (which again lets no pair escape); after the last one no
    bucket can be large, so no task compares an unbounded group."""
    points, found, temps = distinct.select(F.lit(0).cast("long").alias("bucket"), "fp"), [], []
    for depth in range(DEPTH):
        keyed = points.select("fp", F.explode(F.array(*[F.xxhash64(F.col("bucket"), F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks(depth, radius))])).alias("bucket"))
        sizes = written(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "lsh-sizes")
        temps.append(sizes)
        last = depth == DEPTH - 1
        light = sizes if last else sizes.filter(F.col("n") <= heavy)
        dealt = keyed.join(light.select("bucket"), "bucket").repartition("bucket").sortWithinPartitions("bucket")
        found.append(written(dealt.select("bucket", "fp").mapInArrow(_verify(radius), "a long, b long").filter("a <> b"), "lsh-links"))
        if last or sizes.filter(F.col("n") > heavy).isEmpty():
            break
        points = written(keyed.join(sizes.filter(F.col("n") > heavy).select("bucket"), "bucket").select("bucket", "fp"), "lsh-heavy")
        temps.append(points)
    out = written(reduce(DataFrame.unionByName, found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    discard(*temps, *found)
    return out


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of every node that has an edge; label: the smallest ``rank`` reachable (null only if all are).

    ``nodes``: (node long, rank); ``edges``: (a, b long). Labels spread along edges and then jump to their
    own label's label, so rounds grow with the logarithm of a component's diameter in common cases. Each
    round is one map-side combined minimum and two joins; nothing is gathered by component."""
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    ends = both.select(F.col("u").alias("node")).distinct()
    labels = written(ends.join(nodes, "node").select("node", F.struct(F.col("rank").isNull().alias("none"), F.col("rank"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("m"))
        spread = labels.join(near, F.col("node") == F.col("u")).select("node", "label", F.least("label", "m").alias("to"))
        far = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        step = spread.join(far, F.col("to.node") == F.col("at")).select("node", F.least("to", "beyond").alias("label"), (F.least("to", "beyond") != F.col("label")).alias("changed"))
        new = written(step, "labels")
        changed = not new.filter("changed").isEmpty()
        discard(labels)
        labels = new.drop("changed")
        labels._scratch_path = new._scratch_path
        if not changed:
            discard(both)
            return labels.select("node", F.col("label.rank").alias("label"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Null and empty texts, and texts of white space alone, have fingerprint zero and link like any other;
    texts with fewer words than a shingle hash all their words. Copies and repeated rows share a
    fingerprint and so a component; component_id is the smallest id reachable (null only if all are). Very
    long texts are hashed whole. Other columns are not read; an empty table gives an empty result.

    Scale: 16 bytes a row are kept; equal fingerprints are joined map-side before the tables are built."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("id").alias("rank")), "distinct")
    edges = links(distinct, radius)
    labels = components(distinct.select(F.col("fp").alias("node"), "rank"), edges)
    comp = written(distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", F.when(F.col("node").isNull(), F.col("rank")).otherwise(F.col("label")).alias("component_id")), "components")
    discard(edges, distinct)
    return fps.join(comp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
