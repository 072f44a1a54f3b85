"""Greedy word-piece lengths by a linear longest-match automaton.

Each trie node has a failure link and the precomputed number of tokens popped by following it,
so a word is counted in one pass over its characters, without building pieces or backing up.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Mark that begins a word in the vocabulary.
WORD_START = "▁"
#: Words remembered by a Python worker before it starts over.
CACHE_WORDS = 400_000
#: Steps (node, character) remembered by an automaton.
STEPS = 400_000
#: Leading characters whose state is remembered.
HEAD = 5


class LongestMatch:
    """Counts greedy longest-match tokens of a string.

    A character that begins no piece stands for as many tokens as its UTF-8 form has bytes."""

    def __init__(self, pieces: Iterable[str]):
        go: list[dict[str, int]] = [{}]
        popped = [0]  # tokens popped by following the failure link
        whole = [False]
        order: list[tuple[int, int, str]] = []  # (node, parent, character)
        for piece in pieces:
            at = 0
            for c in piece:
                nxt = go[at].get(c)
                if nxt is None:
                    nxt = go[at][c] = len(go)
                    go.append({})
                    popped.append(0)
                    whole.append(False)
                    order.append((nxt, at, c))
                at = nxt
            whole[at] = bool(at)
        depth = [0] * len(go)
        for node, parent, _ in order:
            depth[node] = depth[parent] + 1
        fail = [0] * len(go)
        for node, parent, c in sorted(order, key=lambda x: depth[x[0]]):
            if whole[node] or parent == 0:
                popped[node] = 1 if whole[node] else len(c.encode("utf-8", "surrogatepass"))
                continue
            z, n = fail[parent], popped[parent]
            while z and c not in go[z]:
                n, z = n + popped[z], fail[z]
            nxt = go[z].get(c)
            if nxt is None:  # only at the root: the character is popped as bytes at once
                nxt, n = 0, n + len(c.encode("utf-8", "surrogatepass"))
            fail[node], popped[node] = nxt, n
        self.go, self.fail, self.popped = go, fail, popped
        # Tokens left when a text ends at a node: those popped on the way back to the root.
        self.rest = [0] * len(go)
        for node in sorted(range(1, len(go)), key=lambda x: depth[x]):
            self.rest[node] = popped[node] + self.rest[fail[node]]
        self.steps: list[dict[str, tuple[int, int]]] = [{} for _ in go]
        self.room = STEPS
        self.heads: dict[str, tuple[int, int]] = {}

    def _step(self, at: int, c: str) -> tuple[int, int]:
        """Next node and tokens popped on the way, following failure links; remembered while there is room."""
        start, n = at, 0
        while at and c not in self.go[at]:
            n, at = n + self.popped[at], self.fail[at]
        nxt = self.go[at].get(c)
        found = (0, n + len(c.encode("utf-8", "surrogatepass"))) if nxt is None else (nxt, n)
        if self.room > 0:
            self.room -= 1
            self.steps[start][c] = found
        return found

    def _run(self, text: str, at: int = 0, n: int = 0) -> tuple[int, int]:
        steps = self.steps
        for c in text:
            at, k = steps[at].get(c) or self._step(at, c)
            n += k
        return at, n

    def count(self, text: str) -> int:
        head = text[:HEAD]
        found = self.heads.get(head)
        if found is None:
            found = self._run(head)
            if len(self.heads) < STEPS:
                self.heads[head] = found
        steps = self.steps
        at, n = found
        for c in text[HEAD:]:
            at, k = steps[at].get(c) or self._step(at, c)
            n += k
        return n + self.rest[at]


class WordCounts(dict):
    """word -> tokens; remembers words, and forgets all of them when full."""

    def __init__(self, automaton: LongestMatch, most: int = CACHE_WORDS):
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self.automaton.count(WORD_START + word)
        if len(word) <= 64:
            self[word] = n
        return n


_COUNTERS: dict[int, WordCounts] = {}


def counter(pieces: tuple[str, ...]) -> WordCounts:
    """This worker's counter for a vocabulary; built once."""
    key = hash(pieces)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = WordCounts(LongestMatch(pieces))
    return _COUNTERS[key]


def load_pieces(path: str) -> tuple[str, ...]:
    """Ordinary pieces of a SentencePiece model: no control, unknown or byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))


def token_counts(docs: DataFrame, pieces: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_tokens (long).

    Words are the runs between white space; each is counted with the word-start mark before it. Null and
    empty texts have no words and no tokens. Rows, ids and ties are kept as they are; other columns are
    not read; an empty table gives an empty result. No shuffle; the vocabulary is broadcast (its size is
    that of the file given)."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = counter(shared.value).__getitem__
        for b in batches:
            words, tokens = [], []
            for t in b.column("text"):
                w = (t.as_py() or "").split()
                words.append(len(w))
                tokens.append(sum(map(get, w)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["id", "n_words", "n_tokens"])

    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return base.mapInArrow(counts, f"id {dict(base.dtypes)['id']}, n_words long, n_tokens long").withColumnRenamed("id", id_col)


def op4_wordpiece_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(table(spark, sf_dir, "documents"), load_pieces(vocabulary))
