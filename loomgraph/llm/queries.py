"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from loomgraph.llm import chat, chunk_dedup, dart_minhash, hash_tree, packing, phrase_index, pii, substring_dedup, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        dart_minhash.op1_dart_minhash,
        pii.op2_weak_supervision_pii,
        chat.op3_prefix_target,
        substring_dedup.op4_repeated_phrase_automata,
        toxicity.op5_nn_pu_toxicity,
        phrase_index.op6_positional_index_decontamination,
        packing.op7_cost_balanced_packing,
        warc.op8_content_addressed_warc,
        hash_tree.op9_weighted_hash_tree,
        chunk_dedup.op10_chunk_recipe_dedup,
    )
}
SQL = {
    "op3_prefix_target": chat.OP3_SQL,
    "op4_repeated_phrase_automata": substring_dedup.OP4_SQL,
    "op6_positional_index_decontamination": phrase_index.OP6_SQL,
    "op8_content_addressed_warc": warc.OP8_SQL,
    "op10_chunk_recipe_dedup": chunk_dedup.OP10_SQL,
}
