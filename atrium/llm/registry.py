"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from atrium.llm import (
    collocations, decontaminate, divergence, html_text, minhash_dedup, packing, quality, secret_scan, simhash, substring_dedup, token_counts, toxicity, warc,
)

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_packing": packing.op5_packing,
    "op6_html_text": html_text.op6_html_text,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_warc_fixity": warc.op8_warc_fixity,
    "op9_simhash": simhash.op9_simhash,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_collocations": collocations.op11_collocations,
    "op12_minhash_dedup": minhash_dedup.op12_minhash_dedup,
    "op13_source_divergence": divergence.op13_source_divergence,
}
ORACLES = {
    "op3_decontamination": decontaminate.ORACLE,
    "op7_secret_scan": secret_scan.ORACLE,
    "op8_warc_fixity": warc.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_minhash_dedup": minhash_dedup.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
