"""The pipeline's form of SimHash near-dedup: fingerprints and covering hashing over five-word shingles, decided by Jaccard similarity.

Pairs that the coverings of ``simhash.links`` bring together are verified by their shingle sets. The
radius that coverings can afford is too narrow for a similarity of 0.8 (such pairs differ in about ten of
64 bits), so MinHash bands propose the other pairs: two sets of similarity s share one of BANDS keys of
ROWS minima with probability 1 - (1 - s^ROWS)^BANDS, all but 7 in a million pairs at 0.8, and more above it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .simhash import SEED, components, gram_hashes, links, majority

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
#: Bits of a sketch: each shingle flips one, so two sketches differ in no more bits than their sets in shingles.
SKETCH = 512
#: Sets that similar differ in at most this share of their sizes' sum (with room for rounding).
MOST_APART = (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-9
#: Rows of one batch that is sent on; parts that the pairs of one set are dealt to.
BATCH, SALTS = 1000, 32
#: Sets of a bucket that one task compares with as many others; larger buckets are dealt in parts of this size.
PART = 2048
_RNG = np.random.default_rng(SEED)
_XOR, _ODD = (_RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_MIX, _BAND = _RNG.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1), _RNG.integers(0, 1 << 64, BANDS, np.uint64)
_ODD |= np.uint64(1)


def shingles(text: str | bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles; texts without words have the hash of nothing."""
    grams = gram_hashes(text, shingle)
    return np.unique(grams) if len(grams) else np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)


def bands(grams: np.ndarray) -> np.ndarray:
    """One key a band of minima."""
    best = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(grams), 1024):
        best = np.minimum(best, ((grams[at : at + 1024] ^ _XOR) * _ODD).min(1))
    keys = (best.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64)
    return (keys ^ keys >> np.uint64(32)) * _MIX[0] ^ _BAND


def sketch(grams: np.ndarray) -> bytes:
    """Parity of the number of shingles at each of SKETCH positions."""
    return np.packbits((np.bincount((grams >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            b = whole.slice(at, BATCH)
            grams = [gram_hashes(t.as_py(), SHINGLE) for t in b.column("text")]
            sets = [np.unique(g) if len(g) else shingles(None) for g in grams]
            fps = np.fromiter(map(majority, grams), np.uint64, len(sets))
            nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets))
            keys = np.concatenate([bands(s) for s in sets]).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("k1"), b.column("k2"), pa.array(nodes.view(np.int64)), pa.array(fps.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s) for s in sets], pa.binary()), listed, pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "k1", "k2", "node", "fp", "n", "sketch", "bands", "grams"])


def _similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("left"), b.column("right"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(both >= SIMILARITY * (len(x) + len(y) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _apart(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one unit and different labels whose sketches do not rule the similarity out; a unit of two parts gives the pairs between them."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        keys, nodes, labels, n, part, two = (t.column(c).to_numpy() for c in ("unit", "node", "label", "n", "part", "two"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(n), -1)
        ends, a, b = np.searchsorted(keys, keys, side="right"), [], []
        for i in range(len(n)):
            j = slice(i + 1, ends[i])
            apart = np.flatnonzero((labels[j] != labels[i]) & ((part[j] != part[i]) | ~two[i])) + i + 1
            near = apart[np.bitwise_count(sketch[apart] ^ sketch[i]).sum(1) <= MOST_APART * (n[apart] + n[i])]
            a.append(np.minimum(nodes[near], nodes[i]))
            b.append(np.maximum(nodes[near], nodes[i]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (a, b)], names=["a", "b"])

    held = None
    for batch in batches:
        if batch.num_rows:
            held = pa.concat_tables([*([held] if held else []), pa.Table.from_batches([batch])])
            keys = held.column("unit").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last unit may go on in the next batch
            if cut:
                yield pairs(held.slice(0, cut))
                held = held.slice(cut)
    if held:
        yield pairs(held)


def _verified(pairs: DataFrame, made: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets are similar. A node with many pairs is dealt to SALTS parts."""
    salted = written(pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))), "pairs")
    nodes = salted.select(F.col("a").alias("node")).union(salted.select("b")).distinct()
    sets = written(made.select("node", "grams").join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")
    left = salted.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("grams").alias("left")), "a")
    right = salted.select("a", "b", "salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).alias("turn"))
    other = right.select("b", "turn").distinct().join(sets.select(F.col("node").alias("b"), F.col("grams").alias("right")), "b")
    met = right.join(left.hint("merge"), ["a", "salt"]).join(other.hint("merge"), ["b", "turn"]).select("a", "b", "left", "right")
    out = written(met.mapInArrow(_similar, "a long, b long"), "similar")
    discard(salted, sets)
    return out


def _row_keys(id_: Column, text: Column) -> list[Column]:
    """Two hashes that tell rows apart by id and text."""
    return [F.xxhash64(id_, text).alias("k1"), F.xxhash64(F.lit("second"), id_, text).alias("k2")]


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, component_id, kept, and k1 and k2, hashes of its id and text.

    component_id is the smallest id reachable by pairs of similarity SIMILARITY or more (null only if all
    are); kept marks the row of each component with the smallest id (null ids last), then the smallest
    hashes. Rows that repeat an id with another text are told apart; rows that repeat id and text have the
    same keys and are all marked. Null, empty and blank texts are equal to each other; very long texts are
    hashed whole. Other columns are not read; an empty table gives an empty result.

    Scale: sets are first compared along the links of the fingerprints' coverings, and with two sets of each
    of their band buckets, which joins the usual group of copies in linear time. Then all pairs of a bucket
    that are still in different components are compared, by sketches in units of two parts of the bucket
    (none above PART in expectation), and by their sets where the sketches allow the similarity."""
    text = F.col(f"`{text_col}`").cast("string")
    base = docs.select(F.col(f"`{id_col}`").alias("id"), *_row_keys(F.col(f"`{id_col}`"), text), text.cast("binary").alias("text"))
    made = written(base.mapInArrow(_sets, f"id {dict(base.dtypes)['id']}, k1 long, k2 long, node long, fp long, n int, sketch binary, bands array<long>, grams binary"), "shingles")
    keyed = made.select("node", F.explode("bands").alias("bucket"))
    buckets = written(keyed.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high"), "buckets")
    members = written(keyed.join(buckets, "bucket").distinct(), "members")
    hubs = members.select("node", F.explode(F.array("low", "high")).alias("hub")).filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    prints = written(made.groupBy("fp").agg(F.min("node").alias("node")), "prints")
    near = links(prints.select("fp"))
    ends = [prints.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node")) for c in ("a", "b")]
    covered = near.join(ends[0], "a").join(ends[1], "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    same = made.select("fp", F.col("node").alias("b")).distinct().join(prints, "fp").filter("node <> b").select(F.col("node").alias("a"), "b")
    tried = reduce(DataFrame.unionByName, (hubs, covered, same)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = _verified(tried, made)
    every = made.select("node", F.col("node").alias("rank")).distinct()
    labels = components(every, edges)

    labelled = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count(F.lit(1)).alias("size")).filter("l <> h").select("bucket", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    heads = made.select("node", "n", "sketch").distinct()
    dealt = labelled.join(mixed, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = dealt.select(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("unit"), "node", "label", "part", (F.col("part") != F.col("other")).alias("two"))
    open_ = written(units.join(heads, "node").select("unit", "node", "label", "n", "sketch", "part", "two"), "open")
    rest = written(open_.repartition("unit").sortWithinPartitions("unit").mapInArrow(_apart, "a long, b long").distinct(), "rest")
    more = _verified(rest, made)
    if not more.isEmpty():
        discard(labels)
        labels = components(every, edges.unionByName(more))
    named = written(made.select("id", "k1", "k2", "node").join(labels, "node", "left").select("id", "k1", "k2", F.coalesce("label", "node").alias("label")), "labelled")
    discard(buckets, members, prints, near, open_, rest, edges, more, made)
    least = named.groupBy("label").agg(F.min("id").alias("component_id"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("first"))
    return named.join(least, "label").select(F.col("id").alias(id_col), "component_id", ((F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))).alias("kept"), "k1", "k2")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component one, as ``near_components`` marks it; of rows that repeat its id and text one.

    All columns come back as they are, whatever their names."""
    kept = near_components(docs, id_col, text_col).filter("kept").select("k1", "k2").distinct()
    keyed = docs.select(*_row_keys(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return keyed.join(kept.hint("merge"), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row.*")
