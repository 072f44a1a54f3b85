"""The corpus pipeline: toxicity, exact and near deduplication, mixing and packing, each run over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptaflow.llm import common, exact_dedup, mixing, near_dedup, packing, token_counts, toxicity

#: Scratch tables of finished stages go when the next stage begins: its input has been written by then.
_HELD = {"before": 0}


def _begin(first: bool = False) -> None:
    if first:
        _HELD["before"] = common.release(keep=1 << 60)
    else:
        common.release(keep=_HELD["before"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic (score 0.5 or more) go.

    Null and empty texts have the base rate of texts without terms, and so stay; each row is judged by its own
    text, repeated ids and rows too; very long texts are read whole; an empty table gives an empty one; columns
    come back as they are."""
    _begin(first=True)
    model = toxicity.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model, carry=True).filter("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) the row with the smallest id stays, of rows that also repeat the id one.

    Null counts as empty, a null id as the smallest; texts are compared whole, however long; an empty table gives
    an empty one; columns come back as they are."""
    _begin()
    return exact_dedup.exact_dedup(docs, carry=True).filter("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share four fifths of their five-word shingles the row with the smallest id stays.

    Rows are told apart by id and text, so an id that repeats with another text loses none of its texts; null ids
    come last; null, empty and blank texts are one group; very long texts are hashed whole; an empty table gives
    an empty one; columns come back as they are."""
    _begin()
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that low quality has at most its target share of tokens; posteriors weigh each document.

    Where its share is below the target already, nothing changes. Null and empty texts have no tokens and follow
    their posteriors; repeated ids and rows are mixed alike; very long texts are counted whole; without labels
    nothing is known of quality and the targets are met by equal posteriors; an empty table gives an empty one;
    columns come back as they are."""
    _begin()
    import public_tokenizers

    pieces = token_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    mixed = mixing.mix(docs, mixing.quality_domains(common.table(spark, sf_dir, "labels")), pieces, mixing.QUALITY_TARGETS, carry=True, lowered=mixing.ONLY_LOWERED)
    return mixed.filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences.

    Null and empty texts are documents of the end id alone; each row is packed, repeated ids and rows too; very
    long texts are cut; an empty table gives an empty result; only doc_id and text are read."""
    _begin()
    return packing.pack(docs, *packing.load_ranks())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Nearest-neighbour scores, fitted rates and tokenizers are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = common.written(out, f"stage-{name}")
        common.pin(docs)
    return docs
