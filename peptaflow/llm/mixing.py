"""Mixing sources to target weights by soft domain membership.

A softmax classifier fitted on the labelled table predicts each document's domain posteriors.
Nonnegative rates are then fitted so that the expected tokens of each domain meet its target:
distributed projected gradient on a least-squares misfit. A document's step depends on the
domain misfits alone, so its rate is replayed from the few misfits seen so far and no rate has
to be stored between steps.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, discard, table, with_fields, written
from .token_counts import WORD_START, WordCounts, counter, load_pieces
from .toxicity import _WORD, Terms, word_terms

#: Labelled rows that the classifier is fitted on, at most; least chi-square of a term with a domain (every term that reaches it is kept).
SAMPLE, LEAST_CHI2 = 6000, 30.0
#: Share of all tokens that each domain is to have after mixing.
TARGETS = {"clean": 0.87, "low": 0.08, "toxic": 0.05}
#: The same for the pipeline, whose first stage has removed toxic documents; the low share is only ever lowered.
QUALITY_TARGETS, ONLY_LOWERED = {"high": 0.92, "low": 0.08}, ("low",)
STEPS, TOLERANCE = 40, 1e-3
STYLE = 8
#: Misfits are weighed by the inverse of sum(tokens p p') with this share of its mean diagonal added, so a domain without mass cannot rule the fit.
RIDGE = 1e-3
#: Words that a worker remembers; more where it holds no other operator's words, as in the registered query.
CACHE_WORDS, QUERY_CACHE_WORDS = 400_000, 1_000_000
#: Bits of a word's packed facts: tokens, then one for capitals, then the number of its set of terms.
_TOKENS, _CAPITALS = (1 << 40) - 1, 40
#: Common marks around words; none is part of a term.
_MARKS = ".,;:!?'\"()[]{}<>#*|$%&-+=/"


class RawTerms(Terms):
    """As Terms, for words as they stand between white space: lower-cased, punctuation apart."""

    def find(self, word: str) -> tuple[int, ...]:
        low = word.lower()
        if not low.isalnum():
            low = low.strip(_MARKS)
            if not low.isalnum():
                return tuple(i for w in _WORD.findall(low) for i in super(RawTerms, self).find(w))
        return super().find(low)


class WordFacts:
    """Words' tokens, whether they are in capitals, and their sets of terms, as one number each; forgets all when full."""

    def __init__(self, counts: WordCounts, vocabulary: dict[str, int], most: int = CACHE_WORDS):
        self.count, self.terms, self.most = counts.automaton.count, RawTerms(vocabulary), most
        self.known: dict[str, int] = {}
        self.sets, self.numbers = [()], {(): 0}

    def of(self, words: Sequence[str]) -> np.ndarray:
        """Facts of distinct words."""
        known, count, find = self.known, self.count, self.terms.find
        out = list(map(known.get, words))
        if len(known) >= self.most:
            known.clear()
        for i in [i for i, v in enumerate(out) if v is None]:
            word = words[i]
            v = count(WORD_START + word)
            if word.isupper():
                v |= 1 << _CAPITALS
            if ids := find(word):
                if ids not in self.numbers:
                    self.numbers[ids] = len(self.sets)
                    self.sets.append(ids)
                v |= self.numbers[ids] << _CAPITALS + 1
            out[i] = v
            if len(word) <= 64:
                known[word] = v
        return np.array(out, np.int64)


#: Characters of the texts whose words are looked up together; a longer text is taken by itself.
CHUNK = 1 << 22


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[pa.Array]:
    """Consecutive texts (null as empty) of about ``most`` characters together."""
    texts = pc.fill_null(texts, "")
    start = size = 0
    for i, n in enumerate(pc.utf8_length(texts).to_pylist()):
        if size and size + n > most:
            yield texts.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield texts.slice(start)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of each text as ``str.split`` has them: how many, each one's number, and the distinct words."""
    parts = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)  # white space at either end leaves an empty part
    size = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    n = np.diff(kept[np.concatenate([[0], np.cumsum(size)])])
    coded = flat.filter(full).dictionary_encode()
    known = coded.dictionary.to_pylist()
    if len(set(known)) < len(known) or " ".join(known).split() != known:  # seen: white space left at the end of the last text
        words = [t.split() for t in texts.to_pylist()]
        n, coded = np.fromiter(map(len, words), np.int64, len(words)), pa.array(list(chain.from_iterable(words)), pa.large_string()).dictionary_encode()
        known = coded.dictionary.to_pylist()
    return n, coded.indices.to_numpy().astype(np.int64), known


class DomainModel:
    """Softmax over style features and indicator terms."""

    def __init__(self, domains: Sequence[str], terms: Sequence[str]):
        self.domains, self.vocabulary = list(domains), {t: i for i, t in enumerate(terms)}
        k, d = len(self.domains), STYLE + len(terms) + 1
        self.mean, self.scale, self.weights = np.zeros(STYLE), np.ones(STYLE), np.zeros((d, k))

    def features(self, texts: pa.Array, facts: WordFacts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Style rows (length, letter case, repetition, punctuation), text numbers and terms of the texts' distinct terms, and tokens.

        Each distinct word of the texts is looked up once."""
        n, at, known = split_words(texts)
        found = facts.of(known)
        ends, each = np.cumsum(n), found[at]
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
        tokens, upper = total(each & _TOKENS), total(each >> _CAPITALS & 1)
        pair, times = np.unique(np.repeat(np.arange(len(texts)), n) * max(1, len(known)) + at, return_counts=True)
        row, word = np.divmod(pair, max(1, len(known)))
        distinct, most = np.bincount(row, minlength=len(texts)), np.zeros(len(texts), np.int64)
        if len(row):
            most[n > 0] = np.maximum.reduceat(times, np.searchsorted(row, np.flatnonzero(n > 0)))
        number = found[word] >> _CAPITALS + 1
        row, number = np.divmod(np.unique(row[number > 0] * len(facts.sets) + number[number > 0]), len(facts.sets))
        sizes = np.fromiter(map(len, facts.sets), np.int64, len(facts.sets))
        begin = np.cumsum(sizes) - sizes
        flat = np.fromiter(chain.from_iterable(facts.sets), np.int64, int(sizes.sum()))
        many = sizes[number]
        place = np.repeat(begin[number] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        d = max(1, len(self.vocabulary))
        row, term = np.divmod(np.unique(np.repeat(row, many) * d + flat[place]), d)
        seen = {c: pc.count_substring(texts, c).to_numpy(zero_copy_only=False).astype(float) for c in "|#*!\n"}
        marks = np.column_stack([seen["|"] + seen["#"] + seen["*"], seen["!"], pc.utf8_length(texts).to_numpy(zero_copy_only=False) / 10, seen["\n"]])
        style = np.column_stack([np.log1p(n), np.column_stack([upper, distinct, most, marks]) / np.maximum(n, 1)[:, None]])
        style[n == 0] = 0
        return style, row, term, tokens

    def train(self, styles: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray, steps: int = 120, decay: float = 1e-3) -> None:
        """Accelerated gradient; terms are held sparse, so memory grows with their occurrences."""
        self.mean, self.scale = styles.mean(0), styles.std(0) + 1e-6
        dense = np.hstack([np.clip((styles - self.mean) / self.scale, -5, 5), np.ones((len(y), 1))])
        n, d, ends = len(y), len(self.vocabulary), [*range(STYLE), -1]

        def times(v: np.ndarray) -> np.ndarray:
            z = dense @ v[ends]
            for c in range(v.shape[1]):
                z[:, c] += np.bincount(row, v[STYLE + col, c], n)
            return z

        def back(r: np.ndarray) -> np.ndarray:
            g = np.zeros((STYLE + d + 1, r.shape[1]))
            g[ends] = dense.T @ r
            for c in range(r.shape[1] if d else 0):
                g[STYLE:-1, c] = np.bincount(col, r[row, c], d)
            return g

        probe = np.ones((STYLE + d + 1, 1))
        for _ in range(30):  # largest singular value
            probe = back(times(probe))
            top = float(np.linalg.norm(probe))
            probe /= top
        hot = np.eye(len(self.domains))[y]
        w = v = self.weights
        rate = n / (0.55 * top + n * decay)
        for s in range(steps):
            z = times(v)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            new = v - rate * (back(p - hot) / n + decay * v)
            w, v = new, new + s / (s + 3) * (new - w)
        self.weights = w

    def posteriors(self, styles: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        z = np.clip((styles - self.mean) / self.scale, -5, 5) @ self.weights[:STYLE] + self.weights[-1]
        for c in range(z.shape[1]):
            z[:, c] += np.bincount(row, self.weights[STYLE + col, c], len(z))
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def label_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Domains of the labelled table: toxic, else clean or low by quality."""
    return labels.select(F.col(f"`{id_col}`").alias("id"), F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low").alias("domain")).dropna()


def quality_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Domains of the labelled table by quality alone: high or low."""
    return labels.select(F.col(f"`{id_col}`").alias("id"), F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain")).dropna()


_FACTS: dict[int, WordFacts] = {}


def facts_of(model: DomainModel, pieces: tuple[str, ...], most: int = CACHE_WORDS) -> WordFacts:
    """This worker's facts of words for a model and a vocabulary."""
    key = hash((tuple(model.vocabulary), pieces, most))
    if key not in _FACTS:
        _FACTS.clear()
        _FACTS[key] = WordFacts(counter(pieces), model.vocabulary, most)
    return _FACTS[key]


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: Sequence[str], pieces: tuple[str, ...], sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DomainModel:
    """Fits the classifier on at most ``sample`` labelled rows (by hash of the id) with their whole texts.

    The driver receives the significant terms and one sparse row for each row of the sample, all from ``sample``
    texts however large the corpus is. Rows of one text and domain are one example, so copies have no weight;
    rows with a null id or domain are not used; an id with several domains
    counts with the first of them by name; null texts count as empty, long ones are read whole. With
    fewer than two domains among the labelled rows the posteriors are uniform."""
    names = list(domains)
    number = F.array_position(F.array(*[F.lit(d) for d in names]), F.col("domain")) - 1
    chosen_ids = bounded_sample(labelled.groupBy("id").agg(F.min("domain").alias("domain")).filter(F.col("domain").isin(names)).select("id", number.cast("int").alias("y")), sample, "id")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(chosen_ids), "id")  # at most ``sample`` ids
    chosen = written(met.groupBy("text", "y").agg(F.min("id").alias("id")).repartition(12, F.xxhash64("id", "text")), "labelled")
    total = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        discard(chosen)
        return DomainModel(names, [])
    k = len(names)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter[str]] = [Counter() for _ in range(k)]
        for b in batches:
            for t, y in zip(b.column("text"), b.column("y"), strict=True):
                seen[y.as_py()].update({term for w in set(_WORD.findall(t.as_py().lower())) for term in word_terms(w)})
        for y, c in enumerate(seen):
            found = list(c)
            for i in range(0, len(found), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[i : i + 20_000], pa.string()), pa.array([y] * len(found[i : i + 20_000]), pa.int32()), pa.array([c[t] for t in found[i : i + 20_000]], pa.int64())], names=["term", "y", "n"])

    n_all = sum(total.values())
    counts = chosen.select("text", "y").mapInArrow(count, "term string, y int, n long").groupBy("term").agg(F.sum("n").cast("double").alias("n"), *[F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).cast("double").alias(f"k{y}") for y in range(k)])
    best = []
    for y in range(k):
        n, hit, ny = F.col("n"), F.col(f"k{y}"), total.get(y, 0)
        spread = n * (n_all - n) * ny * (n_all - ny)
        best.append(F.when(spread > 0, n_all * F.pow(hit * n_all - n * ny, F.lit(2.0)) / spread).otherwise(0.0))
    scored = written(counts.select("term", *[c.alias(f"s{y}") for y, c in enumerate(best)]).filter(F.greatest(*[F.col(f"s{y}") for y in range(k)], F.lit(0.0)) >= LEAST_CHI2), "domain-terms")
    picked = sorted(r["term"] for r in scored.select("term").collect())
    model = DomainModel(names, picked)
    shared = docs.sparkSession.sparkContext.broadcast((model, pieces))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, facts = shared.value[0], facts_of(*shared.value)
        for b in batches:
            styles, terms = [], []
            for texts in chunks(b.column("text")):
                shape, row, term, _ = own.features(texts, facts)
                styles += shape.tolist()
                terms += [t.tolist() for t in np.split(term, np.searchsorted(row, np.arange(1, len(texts))))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(styles, pa.list_(pa.float64())), pa.array(terms, pa.list_(pa.int32()))], names=["id", "y", "style", "terms"])

    rows = sorted(chosen.mapInArrow(extract, f"id {dict(chosen.dtypes)['id']}, y int, style array<double>, terms array<int>").collect(), key=lambda r: (r["id"], r["style"]))
    discard(chosen, scored)
    row, col = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows]), np.fromiter((t for r in rows for t in r["terms"]), np.int64)
    model.train(np.array([r["style"] for r in rows]), row, col, np.array([r["y"] for r in rows]))
    return model


def memberships(docs: DataFrame, model: DomainModel, pieces: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", carry: bool = False, cache: int = CACHE_WORDS) -> DataFrame:
    """(id, tokens, p array) for every row; with ``carry`` also text and ``rest``, a struct of the other columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model, pieces, cache))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, facts = shared.value[0], facts_of(*shared.value)
        for b in batches:
            tokens, p = [], []
            for texts in chunks(b.column("text")):
                styles, row, term, n = own.features(texts, facts)
                tokens += n.tolist()
                p += own.posteriors(styles, row, term).tolist()
            columns = b.columns if carry else [b.column("id")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tokens, pa.int64()), pa.array(p, pa.list_(pa.float64()))], names=[*(b.schema.names if carry else ["id"]), "tokens", "p"])

    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest")] if carry else []))
    schema = with_fields(base.schema if carry else base.select("id").schema, tokens=T.LongType(), p=T.ArrayType(T.DoubleType()))
    return base.mapInArrow(run, schema)


def replay(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates after the projected steps seen so far, from a rate of one."""
    r = np.ones(len(p))
    for y in steps:
        r = np.maximum(0.0, r - p @ y)
    return r


def _posterior_matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def fit_rates(members: DataFrame, targets: Sequence[float], most: int = STEPS, tolerance: float = TOLERANCE, lowered: Sequence[int] = ()) -> tuple[np.ndarray, list[dict[str, list[float]]]]:
    """The steps (misfits scaled by the inverse of sum(tokens p p')) whose replay gives each document's rate, and the trace.

    In the metric that weighs documents by their tokens the misfit's gradient has a Lipschitz constant of at
    most one, so unit steps are safe, and all but exact where no rate meets zero. Targets that posteriors cannot
    tell apart are approached as far as ``most`` steps lead. Domains ``lowered`` whose share is below their
    target keep it, and the others share the rest. The trace begins with the goal; the driver sees k by k sums."""
    k = len(targets)
    goal = np.array(targets, float) / sum(targets)

    def sums(steps: np.ndarray, first: bool) -> np.ndarray:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k + k * k)
            for b in batches:
                if not b.num_rows:
                    continue
                p, n = _posterior_matrix(b, k), b.column("tokens").to_numpy().astype(float)
                total[:k] += (n * replay(p, steps)) @ p
                if first:
                    total[k:] += ((p * n[:, None]).T @ p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k), pa.int32()), pa.array(total)], names=["i", "v"])

        out = np.zeros(k + k * k)
        for r in members.select("tokens", "p").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out

    steps: list[np.ndarray] = []
    got = sums(np.zeros((0, k)), True)
    s, m = got[:k], got[k:].reshape(k, k)
    total = float(s.sum())
    if total and any(s[i] < goal[i] * total for i in lowered):
        less = [i for i in lowered if s[i] < goal[i] * total]
        others = [i for i in range(k) if i not in less]
        goal[less] = s[less] / total
        goal[others] *= (1 - goal[less].sum()) / max(goal[others].sum(), 1e-300)
    trace = [{"tokens": s.tolist(), "goal": goal.tolist()}]
    if not total:
        return np.zeros((0, k)), trace
    inverse = np.linalg.inv(m + RIDGE * np.trace(m) * np.eye(k) / k)
    for _ in range(most):
        gap = s - goal * total
        if np.abs(gap).max() <= tolerance * total:
            break
        steps.append(inverse @ gap)
        new = sums(np.array(steps), False)[:k]
        trace.append({"tokens": new.tolist()})
        if np.abs(new - s).max() <= 1e-2 * tolerance * total:
            break
        s = new
    return np.array(steps).reshape(-1, k), trace


def rated(members: DataFrame, steps: np.ndarray) -> DataFrame:
    """Adds rate, and copies: the rate rounded up or down by a hash of the id, so that copies average to rates."""
    k = steps.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(replay(_posterior_matrix(b, k), steps) if b.num_rows else np.zeros(0))], names=[*b.schema.names, "rate"])

    unit = F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit("copies")), 11).cast("double") / F.lit(float(1 << 53))
    return members.mapInArrow(run, with_fields(members.schema, rate=T.DoubleType())).withColumn("copies", (F.floor("rate") + (unit < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def mix(docs: DataFrame, labelled: DataFrame, pieces: tuple[str, ...], targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, lowered: Sequence[str] = (), cache: int = CACHE_WORDS) -> DataFrame:
    """One row per input row: id, tokens, p_<domain>..., rate, copies, target_gap; with ``carry`` also ``row``, a struct of all input columns.

    ``labelled``: (id, domain); ``lowered``: domains whose share is lowered to the target but never raised. Null and empty texts have no tokens and take the rate of their posteriors.
    Rows and ids, repeated or null, are kept; rows that share an id share the rounding; other columns are
    not read. Without labelled rows posteriors are uniform; an empty table gives an empty result. Very long
    texts are counted whole. ``target_gap``, the same in every row, is the largest difference between a
    domain's share of the rated tokens and its target: above TOLERANCE, the posteriors do not allow the
    targets. No shuffle but that of k by k sums."""
    targets = targets or TARGETS
    model = fit_domains(docs, labelled, list(targets), pieces, id_col=id_col, text_col=text_col)
    members = written(memberships(docs, model, pieces, id_col, text_col, carry, cache), "memberships")
    steps, trace = fit_rates(members, list(targets.values()), lowered=[list(targets).index(d) for d in lowered])
    reached = np.array(trace[-1]["tokens"])
    gap = float(np.abs(reached / reached.sum() - np.array(trace[0]["goal"])).max()) if reached.sum() else 0.0
    out = rated(members, steps)
    cols = [F.col("id").alias(id_col), "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(targets)], "rate", "copies", F.lit(gap).alias("target_gap")]
    if carry:
        cols.append(F.struct(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]).alias("row"))
    return out.select(*cols)


def op8_soft_mixing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    pieces = load_pieces(vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
    return mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), pieces, cache=QUERY_CACHE_WORDS)
