"""The corpus operators as named queries, and the SQL of those that SQL can express."""

from tickloom.llm.conversation_repair import op13_checkpointed_repair
from tickloom.llm.decontamination import DECONTAMINATION_SQL, op9_prefix_join
from tickloom.llm.html_text import op5_line_blocks
from tickloom.llm.license_scan import license_sql, op6_sentence_rules
from tickloom.llm.minhash_dedup import op12_tensored_minhash
from tickloom.llm.mixing import MIXING_SQL, op4_weighted_fair_queueing
from tickloom.llm.quality_model import op3_histogram_trees
from tickloom.llm.quality_rules import RULES_SQL, op2_host_rules
from tickloom.llm.sharding import op1_virtual_slots
from tickloom.llm.simhash_dedup import op8_anchor_points
from tickloom.llm.token_store import op10_wavelet_matrix
from tickloom.llm.toxicity import op7_positive_unlabelled
from tickloom.llm.whitening import op11_jacobi_davidson

QUERIES = {f.__name__: f for f in (
    op1_virtual_slots, op2_host_rules, op3_histogram_trees, op4_weighted_fair_queueing, op5_line_blocks, op6_sentence_rules,
    op7_positive_unlabelled, op8_anchor_points, op9_prefix_join, op10_wavelet_matrix,
    op11_jacobi_davidson, op12_tensored_minhash, op13_checkpointed_repair)}

SQL = {
    "op2_host_rules": RULES_SQL,
    "op4_weighted_fair_queueing": MIXING_SQL,
    "op6_sentence_rules": license_sql(),
    "op9_prefix_join": DECONTAMINATION_SQL,
}
