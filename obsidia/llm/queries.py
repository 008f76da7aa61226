"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from obsidia.llm.benchmarks import OP10_SQL, op10_decontaminate
from obsidia.llm.codes import OP13_SQL, op13_vector_codes
from obsidia.llm.language import op8_language_id
from obsidia.llm.lines import op5_line_dedup
from obsidia.llm.near_duplicates import op9_near_duplicates
from obsidia.llm.packing import op4_pack
from obsidia.llm.private import op6_private_data
from obsidia.llm.quality import op2_quality_rules
from obsidia.llm.runs import op11_periodic_runs
from obsidia.llm.suffixes import op3_suffix_dedup
from obsidia.llm.token_counts import op1_token_counts
from obsidia.llm.token_files import op7_token_files
from obsidia.llm.toxicity import op12_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_pack": op4_pack,
    "op5_line_dedup": op5_line_dedup,
    "op6_private_data": op6_private_data,
    "op7_token_files": op7_token_files,
    "op8_language_id": op8_language_id,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_decontaminate": op10_decontaminate,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_toxicity": op12_toxicity,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE_SQL = {"op10_decontaminate": OP10_SQL, "op13_vector_codes": OP13_SQL}
