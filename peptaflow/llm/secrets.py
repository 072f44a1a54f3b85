"""Secret scanning: three fixed patterns, and a token-efficiency test for random strings.

A tokenizer spends few characters per token on random strings and many on words, so a run
of key-like characters whose characters-per-token ratio is low is reported, unless it is a known
kind of digest or identifier.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed patterns and least lengths of the base kinds.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run of 16+ is found whole, as with + and a length test
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "random")

#: Runs that the token-efficiency test looks at, and the ratio below which they are reported.
CANDIDATE, LEAST_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20
CHARS_PER_TOKEN = 2.0
#: Parts of a run that are judged by themselves, and the length of windows of parts without separators.
_EQUAL, _PART, WINDOW = re.compile(r"[A-Za-z0-9+/_-]{20,}"), re.compile(r"[A-Za-z0-9]{20,}"), 24

#: Known digests and identifiers, never reported by the test.
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})\Z")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
_SUBRESOURCE = re.compile(r"sha(?:256|384|512)-[A-Za-z0-9+/]+={0,2}\Z")
_NAME = re.compile(r"[A-Za-z]{0,3}(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[_/=+-](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*\Z")
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")


def _whole(text: str) -> bool:
    """A digest, UUID or subresource hash: no part of it is judged."""
    return bool(_DIGEST.match(text) or _UUID.match(text) or _SUBRESOURCE.match(text))


def known(text: str) -> bool:
    """A digest of a usual length, a UUID, a subresource hash, a number, or a name made of words and short numbers."""
    if not _LETTER.search(text):
        return True
    return bool(_DIGEST.match(text) or _UUID.match(text) or _SUBRESOURCE.match(text) or (_DIGIT.search(text) and _NAME.match(text)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the three fixed kinds, sorted."""
    low = text.lower()
    out = []
    if "pass" in low or "secret" in low or "token" in low or "api" in low or not text.isascii():
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Efficiency:
    """Characters per token under a byte-pair vocabulary."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def random(self, text: str, least: float = CHARS_PER_TOKEN) -> bool:
        return len(text) < least * len(self.encoding.encode_ordinary(text))


def _parts(start: int, run: str, judge: Efficiency) -> Iterator[tuple[int, int]]:
    """Parts of a run that are random although the run is not: between separators, coarse ones first, and windows of long parts."""
    covered = 0
    for m in _EQUAL.finditer(run):
        found = [m.span()] if m[0] != run and not known(m[0]) and judge.random(m[0]) else []
        if not found and not _whole(m[0]):
            for part in _PART.finditer(run, m.start(), m.end()):
                text = part[0]
                if _whole(text):
                    continue
                if len(text) < len(run) and not known(text) and judge.random(text):
                    found.append(part.span())
                else:
                    found += _windows(part.start(), text, judge)
        for s, e in found:
            if e > covered:
                yield start + max(s, covered), start + e
                covered = e


def _windows(start: int, text: str, judge: Efficiency) -> list[tuple[int, int]]:
    """Random windows of a part without separators, joined where they overlap."""
    out: list[tuple[int, int]] = []
    if len(text) < 2 * WINDOW or text.isdigit():
        return out
    for i in range(0, len(text) - WINDOW + 1, WINDOW // 4):
        if not known(text[i : i + WINDOW]) and judge.random(text[i : i + WINDOW]):
            if out and start + i <= out[-1][1]:
                out[-1] = (out[-1][0], start + i + WINDOW)
            else:
                out.append((start + i, start + i + WINDOW))
    return out


def _free(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Parts of a range that the sorted spans leave; long enough to be judged. Spans that end before the range are dropped from the list's end."""
    while taken and taken[-1][1] <= start:
        taken.pop()
    held = []
    while taken and taken[-1][0] < end:
        s, e = taken.pop()
        if s - start >= LEAST_RUN:
            yield start, s
        start = max(start, e)
        if e > end:  # it may reach the next range
            held.append((s, e))
    taken.extend(held)
    if end - start >= LEAST_RUN:
        yield start, end


def random_spans(text: str, taken: list[tuple[int, int, int]], judge: Efficiency) -> list[tuple[int, int, int]]:
    """Spans that the token-efficiency test adds: whole runs, else their random parts. A run that touches a base span is judged where that leaves it."""
    out, todo = [], sorted(((s, e) for s, _, e in taken), reverse=True)
    for m in CANDIDATE.finditer(text):
        if _whole(m[0]):
            continue
        for start, end in _free(*m.span(), todo):
            part = text[start:end]
            if _whole(part):
                continue
            out += [(s, 3, e) for s, e in ([(start, end)] if not known(part) and judge.random(part) else _parts(start, part, judge))]
    return out


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_JUDGES: dict[int, Efficiency] = {}


def secret_scan(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans.

    ``ranks``: contents of a tiktoken rank file; ``pattern``: its splitting pattern. Null and empty texts
    have no spans. Rows and ids, repeated or null, are kept as they are; other columns are not read; an
    empty table gives an empty result. Offsets are code points, ends exclusive. Very long texts and runs are
    judged whole, in time that grows with their length. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (key := hash(shared.value)) not in _JUDGES:
            _JUDGES[key] = Efficiency(*shared.value)
        judge = _JUDGES[key]
        for b in batches:
            counts, digests, spans = ([], [], []), [], []
            for t in b.column("text"):
                text = t.as_py() or ""
                found = base_spans(text)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in found))
                digests.append(hashlib.sha256(joined(found).encode()).hexdigest())
                spans.append(joined(sorted(found + random_spans(text, found, judge))))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return base.mapInArrow(scan, f"id {dict(base.dtypes)['id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def op5_secret_scan(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return secret_scan(table(spark, sf_dir, "documents"), f.read(), public_tokenizers.PATTERN)
