"""The training-data queries and what SQL can say of them."""

from __future__ import annotations

from . import kneser_ney, log_bilinear, lsh, mixing, multi_index, packing, pii, repair, rules, simhash, substrings, token_store, treaps


def queries() -> dict:
    return {
        "op1_quality": kneser_ney.op1_quality,
        "op2_pii": pii.op2_pii,
        "op3_scores": log_bilinear.op3_scores,
        "op4_mixing": mixing.op4_mixing,
        "op5_simhash": simhash.op5_simhash,
        "op6_rules": rules.op6_rules,
        "op7_embeddings": lsh.op7_embeddings,
        "op8_tokens": token_store.op8_tokens,
        "op9_packing": packing.op9_packing,
        "op10_substrings": substrings.op10_substrings,
        "op11_search": treaps.op11_search,
        "op12_repair": repair.op12_repair,
        "op13_neighbours": multi_index.op13_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.SQL, "op6_rules": rules.SQL, "op11_search": treaps.SQL, "op12_repair": repair.SQL}
