"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import decontaminate, language_model, licenses, neardup, neighbours, packing, prefix_trie, search, secret_scan, simhash, substring, suffixes, toxicity
from .sql import ORACLE_SQL as ORACLE_SQL

QUERIES = {
    "op1_license": licenses.op1_license,
    "op2_pack": packing.op2_pack,
    "op3_substring": substring.op3_substring,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_suffix": suffixes.op5_suffix,
    "op6_language_model": language_model.op6_language_model,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_minhash": neardup.op8_minhash,
    "op9_secrets": secret_scan.op9_secrets,
    "op10_permutation": neighbours.op10_permutation,
    "op11_simhash": simhash.op11_simhash,
    "op12_search": search.op12_search,
    "op13_trie": prefix_trie.op13_trie,
}
