"""Queries of this subpackage and their SQL, as ``__spark_entry__`` adds them."""

from __future__ import annotations

import corpus_pipeline

from . import alignment, archives, extraction, interaction, mixing, neardup, packing, pii, quality, search, setjoin, toxicity, urls

QUERIES = {
    "op1_main_text": extraction.query,
    "op2_source_mixing": mixing.query,
    "op3_quality_rules": quality.query,
    "op4_sequence_packing": packing.query,
    "op5_near_duplicates": neardup.query,
    "op6_exact_top_k": search.query,
    "op7_personal_data": pii.query,
    "op8_toxicity": toxicity.query,
    "op9_url_rules": urls.query,
    "op10_arc_to_warc": archives.query,
    "op11_jaccard_join": setjoin.query,
    "op12_filter_interaction": interaction.query,
    "op13_cross_alignment": alignment.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op2_source_mixing": mixing.ORACLE_SQL,
    "op3_quality_rules": quality.ORACLE_SQL,
    "op5_near_duplicates": neardup.ORACLE_SQL,
    "op6_exact_top_k": search.ORACLE_SQL,
    "op7_personal_data": pii.ORACLE_SQL,
    "op9_url_rules": urls.ORACLE_SQL,
    "op10_arc_to_warc": archives.ORACLE_SQL,
    "op11_jaccard_join": setjoin.ORACLE_SQL,
    "op12_filter_interaction": interaction.ORACLE_SQL,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
