"""The queries of this package and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from importlib import import_module

from tessera.llm.oracles import SQL

_NAMES = {
    "op1_packing": "packing",
    "op2_suffix_dedup": "suffix_dedup",
    "op3_toxicity": "toxicity",
    "op4_jaccard_join": "jaccard",
    "op5_quality": "quality",
    "op6_phrase_dedup": "phrase_dedup",
    "op7_decontamination": "decontaminate",
    "op8_langid": "langid",
    "op9_training_order": "training_order",
    "op10_secrets": "secrets",
    "op11_periodic_runs": "periodic_runs",
    "op12_warc": "warc",
    "op13_hard_negatives": "hard_negatives",
}

QUERIES = {name: getattr(import_module(f"tessera.llm.{module}"), name) for name, module in _NAMES.items()}
ORACLE_SQL: dict[str, str] = dict(SQL)
