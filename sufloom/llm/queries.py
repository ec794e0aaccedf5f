"""The registered queries of this subpackage and their SQL, one module for each operator."""

from __future__ import annotations

from sufloom.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13

MODULES = (op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13)


def queries() -> dict:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE_SQL for m in MODULES if getattr(m, "ORACLE_SQL", None)}
