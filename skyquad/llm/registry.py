"""The queries of this subpackage and, where SQL can express them, the SQL to hold them against."""

from __future__ import annotations

from skyquad.llm.conversation import op11_conversation_repair
from skyquad.llm.decontamination import OP2_SQL, op2_decontamination
from skyquad.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from skyquad.llm.fill_middle import OP12_SQL, op12_fill_in_middle
from skyquad.llm.line_dedup import OP6_SQL, op6_line_dedup
from skyquad.llm.lm_scoring import OP9_SQL, op9_lm_scoring
from skyquad.llm.mixing import OP7_SQL, op7_mixing
from skyquad.llm.ngram_join import op3_ngram_join
from skyquad.llm.personal import op13_personal_data
from skyquad.llm.secrets import op4_secret_scan
from skyquad.llm.sharding import op8_sharding
from skyquad.llm.token_output import op1_token_output
from skyquad.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_decontamination": op2_decontamination,
    "op3_ngram_join": op3_ngram_join,
    "op4_secret_scan": op4_secret_scan,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_sharding": op8_sharding,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_personal_data": op13_personal_data,
}

SQL = {
    "op2_decontamination": OP2_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op9_lm_scoring": OP9_SQL,
    "op12_fill_in_middle": OP12_SQL,
}
