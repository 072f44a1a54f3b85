"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and word beginnings whose association with the label is significant in the
labelled sample; fit and score read the same words, of any length. The cosine is exact over these
terms. Postings are grouped by blocks of examples with the greatest weight of each term in each
block, so a search opens blocks in order of their upper bound and stops when no unopened block
can reach the k-th score. Neighbours vote with their cosine; an isotonic fit on leave-one-out
votes calibrates the vote.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, discard, table, with_fields, written

#: Labelled rows that the model is fitted on, at most (those with the smallest hashes of doc_id).
SAMPLE = 8000
#: Least chi-square of a term's association with the label; every term that reaches it is kept, however many or rare.
LEAST_CHI2 = 30.0
NEIGHBOURS, BLOCK = 15, 64
#: Lengths of word beginnings.
STEMS = range(3, 9)
#: Leading letters whose beginnings are remembered.
HEAD = 5
_WORD = re.compile(r"\w+")
CACHE_WORDS = 400_000
#: Scored term counts that a worker remembers, for copies.
CACHE_SCORES = 8_000


def word_terms(word: str) -> list[str]:
    """The word itself, and its beginnings marked with a hyphen."""
    return [word, *(word[:n] + "-" for n in STEMS if n < len(word))]


class Terms:
    """Finds the terms of a word in a vocabulary of words and word beginnings."""

    def __init__(self, vocabulary: dict[str, int]):
        self.words = {t: i for t, i in vocabulary.items() if not t.endswith("-")}
        self.stems = {t[:-1]: i for t, i in vocabulary.items() if t.endswith("-")}
        self.longer: dict[str, list[int]] = {}  # lengths of the beginnings longer than HEAD that share its letters
        for stem in sorted(self.stems, key=len):
            if len(stem) > HEAD and len(stem) not in self.longer.setdefault(stem[:HEAD], []):
                self.longer[stem[:HEAD]].append(len(stem))
        self.heads: dict[str, tuple] = {}

    def _head(self, head: str) -> tuple:
        """Beginnings (length, id) within a word's first letters, and lengths of longer ones; nothing if there are none."""
        short = tuple((n, self.stems[head[:n]]) for n in STEMS if n <= len(head) and head[:n] in self.stems)
        found = (short, self.longer.get(head, ())) if short or head in self.longer else ()
        if len(self.heads) >= CACHE_WORDS:
            self.heads.clear()
        self.heads[head] = found
        return found

    def find(self, word: str) -> tuple[int, ...]:
        ids = () if (i := self.words.get(word)) is None else (i,)
        head = word[:HEAD]
        found = self.heads.get(head)
        if found is None:
            found = self._head(head)
        if not found:
            return ids
        size = len(word)
        ids += tuple(i for n, i in found[0] if n < size)
        for n in found[1]:
            if n >= size:
                break
            if (i := self.stems.get(word[:n])) is not None:
                ids += (i,)
        return ids


class TermIds(dict):
    """word -> ids of its terms in the vocabulary; forgets all when full."""

    def __init__(self, vocabulary: dict[str, int], most: int = CACHE_WORDS):
        super().__init__()
        self.terms, self.most = Terms(vocabulary), most

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.terms.find(word)
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def count(self, text: str) -> Counter[int]:
        """Occurrences of each term in a text; each distinct word is looked up once."""
        words, counts = Counter(_WORD.findall(text.lower())), Counter()
        found = list(map(self.__getitem__, words))
        for ids, n in compress(zip(found, words.values(), strict=True), found):
            for i in ids:
                counts[i] += n
        return counts


class BlockMaxIndex:
    """Exact top-k by cosine over unit vectors; ties to the smaller example number."""

    def __init__(self, vectors: Sequence[dict[int, float]], block: int = BLOCK):
        lead = [max(v, key=lambda t: (v[t], -t)) if v else -1 for v in vectors]
        self.order = sorted((i for i, v in enumerate(vectors) if v), key=lambda i: (lead[i], -vectors[i][lead[i]], i))
        self.ids = np.array(self.order, np.int64)
        self.block, self.blocks = block, -(-len(self.order) // block)
        lists: dict[int, list[tuple[int, float]]] = {}
        for at, i in enumerate(self.order):
            for t, w in vectors[i].items():
                lists.setdefault(t, []).append((at, w))
        self.lists = {}
        for t, entries in lists.items():
            at, w = np.array([e[0] for e in entries]), np.array([e[1] for e in entries])
            blocks, first = np.unique(at // block, return_index=True)
            tops = np.maximum.reduceat(w, first)
            ends = [*first[1:].tolist(), len(at)]
            self.lists[t] = (blocks, tops, {b: (at[s:e] - b * block, w[s:e]) for b, s, e in zip(blocks.tolist(), first.tolist(), ends, strict=True)})

    def search(self, query: dict[int, float], k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, scores), best first; only examples that share a term with the query. ``leave``: one to leave out."""
        mine = [(q, self.lists[t]) for t, q in query.items() if t in self.lists]
        bound = np.zeros(self.blocks)
        for q, (blocks, tops, _) in mine:
            bound[blocks] += q * tops
        best_ids, best, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or bound[b] < least - 1e-9:
                break
            scores = np.zeros(self.block)
            for q, (_, _, parts) in mine:
                if b in parts:
                    at, w = parts[b]
                    scores[at] += q * w
            hit = np.flatnonzero(scores > 0)
            ids = np.concatenate([best_ids, self.ids[b * self.block + hit]])
            got = np.concatenate([best, scores[hit]])
            if leave >= 0:
                got, ids = got[ids != leave], ids[ids != leave]
            top = np.lexsort((ids, -got.round(12)))[:k]
            best_ids, best = ids[top], got[top]
            if len(best) == k:
                least = best[-1]
        return best_ids, best


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing least-squares fit of y on x."""
    xs, inverse = np.unique(x, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    value = np.bincount(inverse, weights=y) / weight
    pools: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools[-1]
            pools[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return xs, np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


class ToxicityModel:
    """Vocabulary, inverse document frequencies, labelled examples and calibration; plain data until ``ready``."""

    def __init__(self, terms: list[str], idf: list[float], examples: list[tuple[int, int, dict[int, int]]], k: int = NEIGHBOURS):
        self.vocabulary, self.idf, self.k = {t: i for i, t in enumerate(terms)}, idf, k
        self.doc_ids = [e[0] for e in examples]
        self.labels = np.array([e[1] for e in examples], float)
        vectors = [self.vector(e[2]) for e in examples]
        bare = [i for i, v in enumerate(vectors) if not v]
        total = self.labels.mean() if len(examples) else 0.0
        self.bare = float((self.labels[bare].sum() + total) / (len(bare) + 1))
        self.index = BlockMaxIndex(vectors)
        votes = [(self.vote(*self.index.search(v, k, i)), self.labels[i]) for i, v in enumerate(vectors) if v]
        self.knots = isotonic(np.array([v[0] for v in votes]), np.array([v[1] for v in votes])) if votes else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self.cache: dict[tuple, tuple[float, str]] = {}

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        v = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()} if norm else {}

    def vote(self, ids: np.ndarray, scores: np.ndarray) -> float:
        return float((scores * self.labels[ids]).sum() / scores.sum()) if len(ids) else self.bare

    def ready(self) -> TermIds:
        if not hasattr(self, "terms_of"):
            self.terms_of = TermIds(self.vocabulary)
        return self.terms_of

    def score(self, text: str) -> tuple[float, str]:
        """Calibrated score, and all examples that voted as doc_id:cosine, nearest first."""
        counts = self.ready().count(text)
        if not counts:
            return self.bare, ""
        key = tuple(sorted(counts.items()))
        if key not in self.cache:
            if len(self.cache) >= CACHE_SCORES:
                self.cache.clear()
            ids, scores = self.index.search(self.vector(counts), self.k)
            p = float(np.interp(self.vote(ids, scores), *self.knots))
            self.cache[key] = min(1.0, max(0.0, p)), ",".join(f"{self.doc_ids[i]}:{s:.4f}" for i, s in zip(ids.tolist(), scores.tolist(), strict=True))
        return self.cache[key]


def _count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, toxic = Counter(), Counter()
    for b in batches:
        for t, y in zip(b.column("text"), b.column("y"), strict=True):
            seen = {term for w in set(_WORD.findall((t.as_py() or "").lower())) for term in word_terms(w)}
            n.update(seen)
            if y.as_py():
                toxic.update(seen)
    names = list(n)
    for i in range(0, len(names), 20_000):
        part = names[i : i + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([toxic[t] for t in part], pa.int64())], names=["term", "n", "k"])


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """At most ``most`` labelled training rows (id, text, y) with their whole texts, chosen by hash."""
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    train = marks.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    chosen = bounded_sample(train.groupBy("id").agg(F.max("y").alias("y")), most, "id")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    # The chosen rows are at most ``most`` pairs of numbers.
    return written(texts.join(F.broadcast(chosen), "id").repartition(12, F.xxhash64("id", "text")), "labelled")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fits on a bounded sample of the labelled rows that are not held out. Only label and text are used.

    The driver receives the significant terms and ``sample`` sparse vectors over them, all from ``sample`` texts
    however large the corpus is; whole texts are read, however long. Null and empty texts are examples without
    terms; rows whose id or label is null are not examples; without examples of both labels the score is the one
    label's, or 0 without any; extra columns are not read. With repeated ids
    the first row by text is the example; a document is toxic if any label row of it says so."""
    chosen = labelled_sample(docs, labels, sample, id_col, text_col, label_col)
    total = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_all, n_toxic = sum(total.values()), total.get(1, 0)
    if not n_toxic or n_toxic == n_all:
        discard(chosen)
        return ToxicityModel([], [], [(0, 1, {})] if n_toxic else [])
    stats = chosen.select("text", "y").mapInArrow(_count_terms, "term string, n long, k long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    spread = n * (n_all - n) * n_toxic * (n_all - n_toxic)
    chi2 = F.when(spread > 0, n_all * F.pow(k * n_all - n * n_toxic, F.lit(2.0)) / spread).otherwise(0.0)
    found = stats.withColumn("chi2", chi2).filter(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "term").collect()
    names = [r["term"] for r in found]
    vocabulary = {t: i for i, t in enumerate(names)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = TermIds(vocabulary)
        for b in batches:
            counts = [ids_of.count(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([list(c) for c in counts], pa.list_(pa.int32())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], names=["id", "y", "t", "n"])

    rows = chosen.mapInArrow(count, f"id {dict(chosen.dtypes)['id']}, y int, t array<int>, n array<int>").collect()
    discard(chosen)
    examples = sorted(((r["id"], int(r["y"] > 0), dict(zip(r["t"], r["n"], strict=True))) for r in rows), key=lambda e: (e[0], sorted(e[2].items())))
    return ToxicityModel(names, [math.log((1 + n_all) / (1 + r["n"])) + 1 for r in found], examples)


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id, held_out, score, predicted, evidence; with ``carry`` also ``row``, a struct of all input columns.

    Null and empty texts, and texts without any term of the model, get the base rate of labelled texts
    without terms. Held-out rows are those whose crc32 of the id as text leaves no remainder by 5 (a null id
    is not held out). Rows and ids, repeated or null, are kept; other columns are not read; an empty table
    gives an empty result. Equal cosines go to the smaller example number. Very long texts are counted whole,
    in memory that grows with their distinct words of the vocabulary. No shuffle; the broadcast model is bounded by the sample's parameters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest")] if carry else []))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.score(t.as_py() or "") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.string())], names=[*b.schema.names, "score", "evidence"])

    schema = with_fields(base.schema, score=T.DoubleType(), evidence=T.StringType())
    if not carry:
        base_run = run

        def run(batches):  # the text itself need not come back
            for b in base_run(batches):
                yield b.select(["id", "score", "evidence"])

        schema = with_fields(base.select("id").schema, score=T.DoubleType(), evidence=T.StringType())
    out = base.mapInArrow(run, schema)
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    cols = [F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"]
    if carry:
        cols.append(F.struct(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]).alias("row"))
    return out.select(*cols)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
