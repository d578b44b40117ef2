"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from vecspark.llm import decontaminate, langid, licenses, linededup, neighbours, pieces, pii, simhash, toxicity, warc


def queries() -> dict:
    found = [decontaminate.op1_decontaminate, linededup.op2_linededup, warc.op3_warc, neighbours.op4_neighbours, langid.op5_langid, licenses.op6_licenses, pii.op7_pii, pieces.op8_pieces, toxicity.op9_toxicity, simhash.op10_simhash]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_linededup": linededup.ORACLE, "op3_warc": warc.ORACLE, "op4_neighbours": neighbours.ORACLE, "op6_licenses": licenses.oracle()}
