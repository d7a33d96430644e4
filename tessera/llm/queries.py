"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from .op1_near_dedup import op1_bagminhash_dedup
from .op2_packing import op2_best_fit_packing
from .op3_line_dedup import op3_fuzzy_line_dedup
from .op4_quality import op4_factorisation_machine
from .op5_exact_dedup import OP5_SQL, op5_exact_dedup
from .op6_secrets import op6_grammar_secrets
from .op7_sharding import op7_rendezvous_sharding
from .op8_decontamination import OP8_SQL, op8_fm_index_decontamination
from .op9_language import op9_naive_bayes_language
from .op10_html import op10_recurrent_extraction

QUERIES = {
    f.__name__: f
    for f in (
        op1_bagminhash_dedup, op2_best_fit_packing, op3_fuzzy_line_dedup, op4_factorisation_machine, op5_exact_dedup,
        op6_grammar_secrets, op7_rendezvous_sharding, op8_fm_index_decontamination, op9_naive_bayes_language, op10_recurrent_extraction,
    )
}
SQL = {"op5_exact_dedup": OP5_SQL, "op8_fm_index_decontamination": OP8_SQL}
