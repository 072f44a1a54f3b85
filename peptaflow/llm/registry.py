"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, mixing, packing, quotes, secrets, simhash, token_counts, topk, toxicity, url_filter
from .common import table


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quotation_linking": quotes.op1_quotation_linking,
    "op2_cover_tree_topk": topk.op2_cover_tree_topk,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_wordpiece_counts": token_counts.op4_wordpiece_counts,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_url_cascade": url_filter.op6_url_cascade,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_soft_mixing": mixing.op8_soft_mixing,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_simhash": simhash.op10_simhash,
}
ORACLES = {"op1_quotation_linking": quotes.ORACLE, "op2_cover_tree_topk": topk.ORACLE, "op6_url_cascade": url_filter.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE}
