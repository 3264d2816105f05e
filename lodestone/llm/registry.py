"""Queries of this subpackage and the SQL for those that SQL can express."""

from lodestone.llm import chat_format, context_mixing, html_blocks, mixing, near_dup, packing, shard_tree, topk_threshold, toxicity, winnowing

QUERIES = {
    "op1_topk_threshold": topk_threshold.op1_topk_threshold,
    "op2_near_dup": near_dup.op2_near_dup,
    "op3_html_blocks": html_blocks.op3_html_blocks,
    "op4_context_mixing": context_mixing.op4_context_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_shard_tree": shard_tree.op7_shard_tree,
    "op8_winnowing": winnowing.op8_winnowing,
    "op9_mixing": mixing.op9_mixing,
    "op10_packing": packing.op10_packing,
}
ORACLE_SQL = {**topk_threshold.ORACLE_SQL, **near_dup.ORACLE_SQL, **chat_format.ORACLE_SQL, **mixing.ORACLE_SQL}
