"""The queries of the training-data operators and the SQL that DuckDB can check them with."""

from __future__ import annotations

from . import ann, bpe, gif, jaccard, leaks, lines, negatives, packing, pii, repeats, toxicity, warc, whitening

QUERIES = {
    "op1_media": gif.op1_media,
    "op2_substring_dedup": repeats.op2_substring_dedup,
    "op3_arc_to_warc": warc.op3_arc_to_warc,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_packing": packing.op6_packing,
    "op7_pii": pii.op7_pii,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_nearest": ann.op10_nearest,
    "op11_decontamination": leaks.op11_decontamination,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL = {
    "op2_substring_dedup": repeats.OP2_SQL,
    "op3_arc_to_warc": warc.OP3_SQL,
    "op7_pii": pii.OP7_SQL,
    "op8_line_dedup": lines.OP8_SQL,
    "op11_decontamination": leaks.OP11_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
}
