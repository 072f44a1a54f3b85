"""Column expressions over peptide, codon and header text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 20 canonical residues in matrix order.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
#: Amino acids of the standard code, codons in T, C, A, G order.
_BASES, _CODE = "TCAG", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _CODE[16 * i + 4 * j + k] for i, a in enumerate(_BASES) for j, b in enumerate(_BASES) for k, c in enumerate(_BASES)}
#: Three-letter residue names.
THREE_LETTER = {
    "Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I",
    "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V",
}


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def header_attributes(header: Column) -> Column:
    """Map of the ``key=value`` tokens after the first; tokens without exactly one ``=`` are left out."""
    parts = F.transform(F.filter(F.slice(F.split(header, r"\s+"), 2, 1 << 30), lambda t: F.size(F.split(t, "=")) == 2), lambda t: F.split(t, "="))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(p[0].alias("key"), p[1].alias("value"))))


def header_value(header: Column, key: str) -> Column:
    return F.try_element_at(header_attributes(header), F.lit(key))


def canonical(seq: Column) -> Column:
    """Upper case; selenocysteine and pyrrolysine become X."""
    return F.translate(F.upper(seq), "UO", "XX")


def mask_residues(seq: Column) -> Column:
    """Anything but the 20 residues (case sensitive) becomes X."""
    return F.regexp_replace(seq, f"[^{RESIDUES}]", "X")


def is_peptide(seq: Column) -> Column:
    return seq.rlike(f"^[{RESIDUES}]*$")


def norm_mhc(c: Column) -> Column:
    """Allele name without ``*``, ``HLA-``, ``:`` and ``-``."""
    return F.regexp_replace(c, r"\*|HLA-|:|-", "")


def norm_hla(c: Column) -> Column:
    """Allele name without ``*``, ``HLA-`` and ``:``, trimmed."""
    return F.trim(F.regexp_replace(c, r"\*|HLA-|:", ""))


def norm_hla_workflow(c: Column) -> Column:
    """As ``norm_hla``, with mouse alleles as ``H2-``."""
    return F.regexp_replace(norm_hla(c), "H-2-", "H2-")


def clamped(seq: Column, begin: Column, end: Column) -> Column:
    """The 0-based slice [begin, end), cut to the sequence."""
    b = F.greatest(begin, F.lit(0))
    return F.substring(seq, b + 1, F.greatest(F.least(end, F.length(seq)) - b, F.lit(0)))


def letters(seq: Column) -> Column:
    return F.filter(F.split(seq, ""), lambda x: x != "")


def triplets(seq: Column) -> Column:
    return F.regexp_extract_all(seq, F.lit("(.{3})"), F.lit(1))


def translate_codons(dna: Column) -> Column:
    """Protein up to the first stop or unknown codon; a partial codon at the end is ignored."""
    aa = F.transform(triplets(F.upper(dna)), lambda c: F.coalesce(F.try_element_at(_lookup(CODONS), c), F.lit("*")))
    return F.split(F.concat_ws("", aa), r"\*")[0]


def reverse_complement(dna: Column) -> Column:
    return F.reverse(F.translate(dna, "ATCG", "TAGC"))


def shorten_residues(names: Column) -> Column:
    """Three-letter names to letters; unknown names are skipped, a length that is no multiple of 3 gives null."""
    got = F.transform(triplets(names), lambda c: F.try_element_at(_lookup(THREE_LETTER), c))
    return F.when(F.length(names) % 3 == 0, F.concat_ws("", got))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of equally long texts; a missing or empty one counts the other's length; null for unequal lengths."""
    la, lb = F.coalesce(F.length(a), F.lit(0)), F.coalesce(F.length(b), F.lit(0))
    diff = F.size(F.filter(F.zip_with(letters(a), letters(b), lambda x, y: x != y), lambda d: d))
    return F.when(la == 0, lb).when(lb == 0, la).when(la == lb, diff)


def overlap_hamming(a: Column, b: Column) -> Column:
    """Differing positions over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    return F.size(F.filter(F.zip_with(F.slice(letters(a), 1, n), F.slice(letters(b), 1, n), lambda x, y: x != y), lambda d: d))


def kmers(seq: Column, k: int | Column) -> Column:
    """All windows of length k, in order; none if the sequence is shorter.

    A fixed k is found by one pass of a pattern (not from the second half of a surrogate pair), in time that
    grows with the length; a column of lengths takes a substring for each window."""
    if isinstance(k, int) and k > 0:
        return F.coalesce(F.regexp_extract_all(seq, F.lit(rf"(?s)(?![\uDC00-\uDFFF])(?=(.{{{k}}}))"), F.lit(1)), F.array().cast("array<string>"))
    k = F.lit(k) if isinstance(k, int) else k
    starts = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(seq, i, k))


def neighbours(seq: Column, skip: tuple[int, ...] = (), residues: str = RESIDUES) -> Column:
    """Every sequence with one residue replaced (itself included), leaving out 0-based positions in ``skip``."""
    spots = F.filter(F.sequence(F.lit(1), F.length(seq)), lambda i: ~(i - 1).isin(*skip)) if skip else F.sequence(F.lit(1), F.length(seq))
    every = F.flatten(F.transform(spots, lambda i: F.transform(F.array(*[F.lit(r) for r in residues]), lambda r: F.concat(F.substring(seq, F.lit(1), i - 1), r, F.substring(seq, i + 1, F.length(seq))))))
    return F.when(F.length(seq) > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def mark_changes(et: Column, mt: Column) -> Column:
    """``et`` with residues that differ from ``mt`` in lower case; all lower case if lengths differ."""
    pairs = F.zip_with(letters(et), letters(mt), lambda x, y: F.when(x == y, x).otherwise(F.lower(x)))
    return F.when(F.length(et) == F.length(mt), F.concat_ws("", pairs)).otherwise(F.lower(et))


def wildcard(et: Column) -> Column:
    return F.regexp_replace(et, "[a-z]", "x")


def base36(n: Column) -> Column:
    return F.conv(n.cast("string"), 10, 36)


def strip_version(c: Column) -> Column:
    return F.regexp_replace(c, r"\.\d+$", "")


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9A-Za-z]", "_")


def identity_parts(identity: Column) -> Column:
    """Struct (vtype, moltype, lineno) of ``TYPE_[DRU]<line>_...``; absent parts are null."""
    e = lambda g: F.nullif(F.regexp_extract(identity, r"^([A-Za-z]+)_(?:([DRU])(\d+))?", g), F.lit(""))
    return F.struct(e(1).alias("vtype"), e(2).alias("moltype"), e(3).cast("long").alias("lineno"))


def uri_parts(uri: Column, port: int = 22) -> Column:
    """Struct (user, host, port, path) of ``ssh://user@host:port/path``."""
    e = lambda g: F.nullif(F.regexp_extract(uri, r"^[a-z]+://(?:([^@/]*)@)?([^:/]*)(?::(\d+))?(/.*)?$", g), F.lit(""))
    return F.struct(e(1).alias("user"), e(2).alias("host"), F.coalesce(e(3).cast("int"), F.lit(port)).alias("port"), e(4).alias("path"))


def detail_text(pairs: list[tuple[str, Column]]) -> Column:
    """``name$value`` pairs joined by ``#``."""
    return F.concat_ws("#", *[F.concat(F.lit(n + "$"), F.coalesce(v.cast("string"), F.lit(""))) for n, v in pairs])


def abbreviated(items: Column, head: int = 3, tail: int = 3) -> Column:
    """First and last items of a long array."""
    return F.when(F.size(items) <= head + tail, items).otherwise(F.concat(F.slice(items, 1, head), F.array(F.lit("...")), F.slice(items, -tail, tail)))
