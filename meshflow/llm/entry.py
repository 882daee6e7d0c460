"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bag_minhash, decontaminate, dimension_scan, kneser_ney, language_mixture, piece_viterbi, run_index, token_counts, toxic_crf, url_filter

QUERIES = {
    "op1_language_mixture": language_mixture.op1_language_mixture,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_run_index": run_index.op3_run_index,
    "op4_toxic_crf": toxic_crf.op4_toxic_crf,
    "op5_dimension_scan": dimension_scan.op5_dimension_scan,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_piece_viterbi": piece_viterbi.op7_piece_viterbi,
    "op8_bag_minhash": bag_minhash.op8_bag_minhash,
    "op9_kneser_ney": kneser_ney.op9_kneser_ney,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
ORACLE_SQL = {"op2_url_filter": url_filter.oracle(), "op10_decontaminate": decontaminate.ORACLE}
