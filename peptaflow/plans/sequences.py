"""Sequence algebra on the tables' texts: normalisation, k-mers, seeds, distances, weight matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions import sequences as S
from ..operators import joins, statistics
from . import features, scores
from .registry import Tables, query


@query("""SELECT doc_id, sha256(regexp_replace(translate(upper(replace(text, 'ß', 's')), 'UO', 'XX'), '[^ARNDCQEGHILKMFPSTWYV]', 'X', 'g')) AS pep FROM documents""")
def norm_peptide(t: Tables) -> DataFrame:
    s = S.mask_residues(S.canonical(F.replace(F.col("text"), F.lit("ß"), F.lit("s"))))
    return t.documents.select("doc_id", F.sha2(s, 256).alias("pep"))


@query("SELECT p_partkey, replace(replace(replace(replace('HLA-A*' || p_brand || ':0' || p_size, '*', ''), 'HLA-', ''), ':', ''), '-', '') AS mhc FROM part")
def norm_mhc(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("HLA-A*"), "p_brand", F.lit(":0"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", S.norm_mhc(raw).alias("mhc"))


@query("""SELECT item_id, CAST(i AS INTEGER) AS pos, substr(text, CAST(i AS BIGINT), 9) AS kmer FROM (SELECT item_id, text, unnest(generate_series(1, length(text) - 8)) AS i FROM benchmark)""")
def kmers(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.posexplode(S.kmers(F.col("text"), 9)).alias("p", "kmer")).select("item_id", (F.col("p") + 1).alias("pos"), "kmer")


@query("""WITH k AS (SELECT item_id, substr(text, CAST(i AS BIGINT), 7) AS kmer FROM (SELECT item_id, text, unnest(generate_series(1, length(text) - 6)) AS i FROM benchmark)),
n AS (SELECT DISTINCT substr(text, CAST(i AS BIGINT), 7) AS kmer FROM (SELECT text, unnest(generate_series(1, length(text) - 6)) AS i FROM conversations))
SELECT kmer, min(item_id) AS item_id FROM k WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.kmer = k.kmer) GROUP BY kmer""")
def kmer_anti(t: Tables) -> DataFrame:
    mine = t.benchmark.select("item_id", F.explode(S.kmers(F.col("text"), 7)).alias("kmer")).groupBy("kmer").agg(F.min("item_id").alias("item_id"))
    return joins.unseen(mine, t.conversations.select(F.explode(S.kmers(F.col("text"), 7)).alias("kmer")), "kmer")


_SEEDS = """SELECT DISTINCT {id} AS {id}, substr(text, CAST(i AS BIGINT), 12) AS seed FROM (SELECT {id}, text, unnest(generate_series(1, length(text) - 11)) AS i FROM {t})"""


@query(f"""WITH q AS ({_SEEDS.format(id="item_id", t="benchmark")}), s AS ({_SEEDS.format(id="doc_id", t="documents")}),
p AS (SELECT item_id, doc_id, count(*) AS seeds FROM q JOIN s USING (seed) GROUP BY ALL)
SELECT item_id, doc_id, seeds FROM p QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY seeds DESC, doc_id) = 1""")
def seed_join(t: Tables) -> DataFrame:
    p = joins.seed_pairs(t.benchmark, t.documents, "item_id", "text", "doc_id", "text", 12)
    return joins.best_subject(p, "item_id", "doc_id")


@query("""SELECT p_partkey, CAST(hamming(rpad(p_name, CAST(greatest(length(p_name), length(p_type)) AS INTEGER), '.'), rpad(p_type, CAST(greatest(length(p_name), length(p_type)) AS INTEGER), '.')) AS INTEGER) AS d FROM part""")
def hamming(t: Tables) -> DataFrame:
    n = F.greatest(F.length("p_name"), F.length("p_type"))
    return t.part.select("p_partkey", S.hamming(F.rpad("p_name", n, F.lit(".")), F.rpad("p_type", n, F.lit("."))).alias("d"))


@query("""WITH w AS (SELECT DISTINCT p_name AS w FROM part), a AS (SELECT unnest(string_split('ARNDCQEGHILKMFPSTWYV', '')) AS r), i AS (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM w)
SELECT w, count(*) AS n, min(s) AS first, max(s) AS last FROM (SELECT DISTINCT w, substr(w, 1, CAST(i AS BIGINT) - 1) || r || substr(w, CAST(i AS BIGINT) + 1) AS s FROM i, a) GROUP BY w""")
def neighbours(t: Tables) -> DataFrame:
    w = t.part.select(F.col("p_name").alias("w")).distinct()
    s = w.select("w", F.explode(S.neighbours(F.col("w"))).alias("s"))
    return s.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first"), F.max("s").alias("last"))


_CODON_ROWS = ", ".join(f"('{c}', '{a}')" for c, a in S.CODONS.items())


@query(f"""WITH c(codon, aa) AS (VALUES {_CODON_ROWS}),
d AS (SELECT item_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS dna FROM benchmark),
x AS (SELECT item_id, unnest(range(0, length(dna) // 3)) AS i, dna FROM d),
p AS (SELECT item_id, string_agg(aa, '' ORDER BY i) AS pep FROM x JOIN c ON codon = substr(dna, CAST(3 * i + 1 AS BIGINT), 3) GROUP BY item_id)
SELECT item_id, split_part(pep, '*', 1) AS protein FROM p""")
def translate_codon(t: Tables) -> DataFrame:
    dna = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    return t.benchmark.select("item_id", dna.alias("dna")).select("item_id", S.translate_codons(F.col("dna")).alias("protein"))


@query("""WITH c AS (SELECT unnest(string_split(text, '')) AS symbol FROM benchmark), g AS (SELECT symbol, count(*) AS n FROM c GROUP BY symbol)
SELECT symbol, n, round(n / sum(n) OVER (), 8) AS share, round(-(n / sum(n) OVER ()) * log2(n / sum(n) OVER ()), 8) AS bits FROM g""")
def entropy_bits(t: Tables) -> DataFrame:
    e = statistics.entropy_bits(t.benchmark, S.letters(F.col("text")))
    return e.select("symbol", "n", F.round("share", 8).alias("share"), F.round("bits", 8).alias("bits"))


@query("""WITH c AS (SELECT p_brand, length(p_name) AS len, unnest(range(0, length(p_name))) AS pos, p_name FROM part)
SELECT p_brand, CAST(len AS INTEGER) AS len, CAST(pos AS INTEGER) AS pos, substr(p_name, CAST(pos + 1 AS BIGINT), 1) AS letter, count(*) AS n FROM c GROUP BY ALL""")
def pwm_counts(t: Tables) -> DataFrame:
    return statistics.position_counts(t.part, ["p_brand"], "p_name")


@query("""WITH c AS (SELECT p_partkey, p_brand, length(p_name) AS len, unnest(range(0, length(p_name))) AS pos, p_name FROM part),
l AS (SELECT p_partkey, p_brand, len, pos, substr(p_name, CAST(pos + 1 AS BIGINT), 1) AS letter FROM c),
w AS (SELECT p_brand, len, pos, letter, count(*) AS n FROM l GROUP BY ALL)
SELECT p_partkey, CAST(sum(n) AS BIGINT) AS score FROM l JOIN w USING (p_brand, len, pos, letter) GROUP BY p_partkey""")
def pwm_score(t: Tables) -> DataFrame:
    spread = t.part.select("p_partkey", "p_brand", F.length("p_name").alias("len"), F.posexplode(S.letters(F.col("p_name"))).alias("pos", "letter"))
    matrix = statistics.position_counts(t.part, ["p_brand"], "p_name")
    return spread.join(matrix, ["p_brand", "len", "pos", "letter"]).groupBy("p_partkey").agg(F.sum("n").alias("score"))


@query("""WITH s AS (SELECT label, [CAST(x AS DOUBLE) + 26 FOR x IN embedding] AS a FROM embeddings),
r AS (SELECT label, list_sum([exp(-4.86936 * (26.0 - x)) FOR x IN a]) AS z FROM s) SELECT label, round(max(z / (1 + z)), 6) AS best, round(min(z / (1 + z)), 6) AS least FROM r GROUP BY label""")
def foreignness(t: Tables) -> DataFrame:
    r = numbers.recognition(F.transform("embedding", lambda x: x.cast("double") + 26))
    return t.embeddings.select("label", r.alias("r")).groupBy("label").agg(F.round(F.max("r"), 6).alias("best"), F.round(F.min("r"), 6).alias("least"))


@query("""SELECT p_partkey, CASE WHEN length(p_name) = length(p_type) THEN
  array_to_string([CASE WHEN p_type[i] = p_name[i] THEN p_type[i] ELSE lower(p_type[i]) END FOR i IN range(1, length(p_type) + 1)], '') ELSE lower(p_type) END AS marked,
  array_to_string([CASE WHEN upper(p_name)[i] = upper(reverse(p_name))[i] THEN upper(p_name)[i] ELSE lower(p_name[i]) END FOR i IN range(1, length(p_name) + 1)], '') AS turned FROM part""")
def mark_changes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.mark_changes(F.col("p_type"), F.col("p_name")).alias("marked"), S.mark_changes(F.upper("p_name"), F.upper(F.reverse("p_name"))).alias("turned"))


_DIGITS = " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((event_id // {36**d}) % 36 AS BIGINT) + 1, 1)" for d in range(12, -1, -1))


@query(f"SELECT event_id, CASE WHEN event_id = 0 THEN '0' ELSE ltrim({_DIGITS}, '0') END AS code FROM events")
def base36_ordinal(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.lower(S.base36(F.col("event_id"))).alias("code"))


@query("""WITH c AS (SELECT p_brand, length(p_name) AS len, unnest(range(0, length(p_name))) AS pos, p_name FROM part),
l AS (SELECT p_brand, len, pos, substr(p_name, CAST(pos + 1 AS BIGINT), 1) AS letter FROM c),
g AS (SELECT letter, count(*) / (SELECT count(*) FROM l)::DOUBLE AS share FROM l GROUP BY letter),
n AS (SELECT p_brand, len, pos, letter, count(*) / any_value(share) AS w FROM l JOIN g USING (letter) GROUP BY ALL),
p AS (SELECT *, w / sum(w) OVER (PARTITION BY p_brand, len, pos) AS q FROM n)
SELECT p_brand, CAST(len AS INTEGER) AS len, CAST(pos AS INTEGER) AS pos, letter, round(-q * log2(q), 8) + 0.0 AS bits FROM p
UNION ALL SELECT p_brand, CAST(len AS INTEGER), CAST(pos AS INTEGER), 'X', round(sum(-q * log2(q) * q), 8) + 0.0 FROM p GROUP BY p_brand, len, pos""")
def motif_bits(t: Tables) -> DataFrame:
    background = t.part.select(F.explode(S.letters(F.col("p_name"))).alias("letter"))
    return statistics.motif_bits(t.part, ["p_brand"], "p_name", background).withColumn("bits", F.round("bits", 8) + 0.0)


@query("""SELECT l_orderkey, l_linenumber, round(-4.1922 + 2.2958 * log10(l_quantity + 0.1) - 1.8478 * log10(l_extendedprice) + 0.7698 * ln((l_tax + 0.5) / ln(10)), 8) AS NeoScore,
round(-1.2364 - 1.2146 * log10(l_extendedprice) + 0.9903 * log10(l_tax + 0.5), 8) AS AbbrevNeoScore FROM lineitem""")
def neo_scores(t: Tables) -> DataFrame:
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("a"), (F.col("l_tax").cast("double") + 0.5).alias("s"))
    s = scores.neo_scores(d, "q", "a", "s")
    return s.select("l_orderkey", "l_linenumber", F.round("NeoScore", 8).alias("NeoScore"), F.round("AbbrevNeoScore", 8).alias("AbbrevNeoScore"))


@query("""WITH e AS (SELECT l_returnflag AS wild, l_partkey AS et, min(l_extendedprice) AS least FROM lineitem GROUP BY ALL),
m AS (SELECT wild, et, least, CAST(rank() OVER (PARTITION BY wild ORDER BY least) - 1 AS BIGINT) AS n_less_et, count(*) OVER (PARTITION BY wild) AS n FROM e)
SELECT wild, et, n_less_et, n - n_less_et AS n_not_less_et FROM m""")
def wildcard_et_counts(t: Tables) -> DataFrame:
    e = t.lineitem.groupBy(F.col("l_returnflag").alias("wild"), F.col("l_partkey").alias("et")).agg(F.min("l_extendedprice").alias("least"))
    return features.counts_below(e, e.select("wild", "et", F.col("least").alias("at")), "wild", "least", "at", "n_less_et", "n_not_less_et").select("wild", "et", "n_less_et", "n_not_less_et")
