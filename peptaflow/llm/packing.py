"""Best-fit packing planned on the histogram of lengths.

Best-fit decreasing is run over counts of equal lengths, not over documents: open sequences
are kept as runs of equal free space. Documents then take the planned slots by their rank
within their length.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

CAPACITY = 2048
#: Id put after each document.
END_ID = 0
#: Chunks remembered by a Python worker before it starts over.
CACHE_CHUNKS = 500_000
#: A space that cannot be split at alone: white space follows it.
_RUN = re.compile(r" \s")


class ChunkIds(dict):
    """Word -> ids (little-endian unsigned 32-bit) of the word after one space."""

    def __init__(self, ranks: bytes, pattern: str, special: tuple[tuple[str, int], ...] = (), most: int = CACHE_CHUNKS):
        import tiktoken

        super().__init__()
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if special else None
        byte_ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=byte_ranks, special_tokens={}).encode_ordinary
        self.most = most

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.whole(" " + word)
        if len(word) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Ids of a text; strings of special tokens become those tokens, and the text between them is encoded by itself."""
        if self.marks and any(t in text for t in self.special):
            return b"".join(self.special.get(part) or self.plain(part) for part in self.marks.split(text) if part)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. A token never holds both a space and what stands before it, unless that is white
        space too, so a text is split at its spaces; texts with runs of spaces are encoded whole."""
        if _RUN.search(text) or (text.endswith(" ") and text[-2:-1].isspace()):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


_IDS: dict[int, ChunkIds] = {}


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts. Rows (length, first rank, per sequence, first sequence, offset), sorted, and the number of sequences.

    At most 3 runs of sequences begin for each length, and a run takes at most sqrt(2 * capacity) lengths,
    so the plan has at most 3 * capacity * sqrt(2 * capacity) rows, whatever the number of documents."""
    free: dict[int, list[tuple[int, int]]] = {}  # free space -> runs (first sequence, sequences)
    sizes: list[int] = []  # sorted free spaces that have runs
    rows, n_seq = [], 0

    def put(r: int, start: int, count: int) -> None:
        if r > 0 and count:
            if r not in free:
                free[r] = []
                bisect.insort(sizes, r)
            free[r].append((start, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect.bisect_left(sizes, length)
            if i < len(sizes):
                r = sizes[i]
                start, count = free[r].pop()
                if not free[r]:
                    del free[r]
                    sizes.pop(i)
            else:
                r, start, count = capacity, n_seq, -(-left // (capacity // length))
                n_seq += count
            per, offset = r // length, capacity - r
            full = min(count, left // per)
            if full:
                rows.append((length, rank, per, start, offset))
                put(r - per * length, start, full)
                rank, left = rank + full * per, left - full * per
            if full < count and left:
                rows.append((length, rank, left, start + full, offset))
                put(r - left * length, start + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(r, start + full, count - full)
    out = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return out, n_seq


def pieces(docs: DataFrame, ranks: bytes, pattern: str, special: tuple[tuple[str, int], ...] = (), capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised pieces (id, piece, start, length, ids_crc32) with the task that made them and their rank within task and length."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern, special))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (key := hash(shared.value)) not in _IDS:
            _IDS[key] = ChunkIds(*shared.value)
        ids, task = _IDS[key].ids, TaskContext.get().partitionId()
        seen, end = [0] * (capacity + 1), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, t in enumerate(b.column("text")):
                data = ids(t.as_py() or "") + end
                n = len(data) // 4
                at, k = 0, 0
                size = n % capacity or capacity
                while at < n:
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + size)]))
                    rank.append(seen[size])
                    seen[size] += 1
                    at, k, size = at + size, k + 1, capacity
            cols = [b.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(row), pa.int32()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "piece", "start", "length", "ids_crc32", "task", "rank_in_task"])

    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return base.mapInArrow(cut, f"id {dict(base.dtypes)['id']}, piece int, start long, length long, ids_crc32 long, task int, rank_in_task long")


def pack(docs: DataFrame, ranks: bytes, pattern: str, special: tuple[tuple[str, int], ...] = (), capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty: a document of the end id alone. Each input row is packed, repeated ids and
    rows too; other columns are not read; an empty table gives an empty result. ``special``: strings that are tokens
    of their own, with their ids. A very long text is tokenised whole and cut into pieces.

    Scale: tokenised pieces are written once; the driver sees at most ``capacity`` counts. Ranks come from
    counts per (length, task), so a hot length is never gathered or sorted. The plan's size has a fixed bound."""
    made = written(pieces(docs, ranks, pattern, special, capacity, id_col, text_col), "pieces")
    counts = written(made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(histogram, capacity)
    shared = docs.sparkSession.sparkContext.broadcast((slots, slots[:, 0] << 44 | slots[:, 1]))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = made.join(counts.select("length", "task", before.alias("before")).hint("merge"), ["length", "task"])  # the counts grow with the number of tasks

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, keys = shared.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            slot = rows[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            seq, nth = np.divmod(rank - slot[:, 1], slot[:, 2])
            cols = [*(b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(slot[:, 3] + seq), pa.array(slot[:, 4] + nth * length)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ready = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank_in_task")).alias("rank"))
    return ready.mapInArrow(place, f"id {dict(made.dtypes)['id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)


def load_ranks(path: str | None = None, tokenizer: str | None = None) -> tuple[bytes, str, tuple[tuple[str, int], ...]]:
    """A tiktoken rank file with the vocabulary of a tokenizers file, its pattern, and that file's special tokens."""
    import public_tokenizers

    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        special = tuple((t["content"], t["id"]) for t in json.load(f)["added_tokens"])
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN, special


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), *load_ranks())
