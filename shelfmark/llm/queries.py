"""The queries of this subpackage, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from shelfmark.llm import (
    decontaminate, fingerprint, langid, lattice, line_dedup, mixing, near_dedup, periodic, pii, preference, prefix_trie, substring, warc,
)


def queries():
    return {
        "op1_preference": preference.op1_preference,
        "op2_mixing": mixing.op2_mixing,
        "op3_pii": pii.op3_pii,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_fingerprint": fingerprint.op5_fingerprint,
        "op6_lattice": lattice.op6_lattice,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_language_id": langid.op8_language_id,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_warc": warc.op10_warc,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_substring": substring.op12_substring,
        "op13_periodic_runs": periodic.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_preference": preference.ORACLE,
        "op2_mixing": mixing.ORACLE,
        "op4_decontaminate": decontaminate.ORACLE,
        "op7_near_dedup": near_dedup.ORACLE,
        "op9_line_dedup": line_dedup.ORACLE,
        "op10_warc": warc.ORACLE,
        "op11_prefix_trie": prefix_trie.ORACLE,
        "op12_substring": substring.ORACLE,
        "op13_periodic_runs": periodic.ORACLE,
    }
