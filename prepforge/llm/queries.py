"""The registered queries of the corpus operators, and their DuckDB SQL."""

from prepforge.llm import collocations, decontam, licenses, mixing, negatives, revisits, substrings
from prepforge.llm.collocations import op13_collocations
from prepforge.llm.decontam import op4_decontamination
from prepforge.llm.langid import op6_language_id
from prepforge.llm.licenses import op1_license_scan
from prepforge.llm.mixing import op5_mixing
from prepforge.llm.negatives import op11_hard_negatives
from prepforge.llm.qualityrules import op9_quality_rules
from prepforge.llm.resampling import op2_importance_resampling
from prepforge.llm.revisits import op3_warc_revisits
from prepforge.llm.secretscan import op10_secret_scan
from prepforge.llm.simhash import op8_simhash
from prepforge.llm.substrings import op7_substring_dedup
from prepforge.llm.tokenfiles import op12_token_files

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_importance_resampling": op2_importance_resampling,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_decontamination": op4_decontamination,
    "op5_mixing": op5_mixing,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash": op8_simhash,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scan": op10_secret_scan,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_files": op12_token_files,
    "op13_collocations": op13_collocations,
}
ORACLE = {
    "op1_license_scan": licenses.SQL,
    "op3_warc_revisits": revisits.SQL,
    "op4_decontamination": decontam.SQL,
    "op5_mixing": mixing.SQL,
    "op7_substring_dedup": substrings.SQL,
    "op11_hard_negatives": negatives.SQL,
    "op13_collocations": collocations.SQL,
}
