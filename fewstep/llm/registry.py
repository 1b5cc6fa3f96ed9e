"""Queries of the llm operators, and SQL for those that SQL can express."""

from __future__ import annotations

from fewstep.llm import bpe, langid, licenses, linededup, mixing, neardup, nndescent, permutation, pii, sharding, tandem, toxicity, trie

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_language_id": langid.op2_language_id,
    "op3_bpe": bpe.op3_bpe,
    "op4_personal_data": pii.op4_personal_data,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_shard": sharding.op6_shard,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_embedding_duplicates": nndescent.op8_embedding_duplicates,
    "op9_nearest": permutation.op9_nearest,
    "op10_line_dedup": linededup.op10_line_dedup,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_conversation_trie": trie.op12_conversation_trie,
    "op13_periodic_runs": tandem.op13_periodic_runs,
}

ORACLE_SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op6_shard": sharding.OP6_SQL,
    "op7_license_scan": licenses.OP7_SQL,
    "op12_conversation_trie": trie.OP12_SQL,
}
