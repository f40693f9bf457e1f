"""Queries of the corpus operators and, where SQL can state them, their DuckDB SQL."""

from __future__ import annotations

from relspark.llm import chat_rotation, decontamination, html_extract, mixing, near_dedup, quality_classifier, quality_rules, secrets, toxicity, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_decontamination": decontamination.query,
    "op3_html_extract": html_extract.query,
    "op4_toxicity": toxicity.query,
    "op5_secret_scan": secrets.query,
    "op6_quality_rules": quality_rules.query,
    "op7_chat_rotation": chat_rotation.query,
    "op8_near_dedup": near_dedup.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_mix_sources": mixing.query,
    # Other modes of op2 and op7.
    "chat_dialogues": chat_rotation.dialogue_query,
    "decontamination_proximity": decontamination.proximity_query,
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op2_decontamination": decontamination.ORACLE,
    "op5_secret_scan": secrets.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op7_chat_rotation": chat_rotation.ORACLE,
    "op8_near_dedup": near_dedup.ORACLE,
    "op10_mix_sources": mixing.ORACLE,
    "chat_dialogues": chat_rotation.DIALOGUE_ORACLE,
    "decontamination_proximity": decontamination.PROXIMITY_ORACLE,
}
