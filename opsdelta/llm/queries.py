"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from . import decontaminate, exact_dedup, fill_in_middle, hard_negatives, jaccard_join, language, license_scan, packing, pieces, quality, secret_scan, token_files, toxicity

QUERIES = {
    "op1_language": language.query,
    "op2_toxicity": toxicity.query,
    "op3_sentence_pieces": pieces.query,
    "op4_quality": quality.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_token_files": token_files.query,
    "op7_secret_scan": secret_scan.query,
    "op8_decontaminate": decontaminate.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_license_scan": license_scan.query,
    "op11_packing": packing.query,
    "op12_fill_in_middle": fill_in_middle.query,
    "op13_hard_negatives": hard_negatives.query,
}
ORACLES = {
    "op8_decontaminate": decontaminate.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
