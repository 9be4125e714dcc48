"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query -> module. A query without SQL is tested against brute force, a round trip or held-out labels.
MODULES = {
    "op1_warc_normaliser": "warc",
    "op2_line_bitmaps": "line_dedup",
    "op3_simple8b_tokens": "token_files",
    "op4_latent_neighbours": "quality",
    "op5_simhash_bktree": "simhash",
    "op6_fair_queue_mix": "mixing",
    "op7_bm25_wand": "decontaminate",
    "op8_wrapper_induction": "html_wrappers",
    "op9_min_cost_reshard": "sharding",
    "op10_tokenizer_fertility": "tokenizer_rules",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
