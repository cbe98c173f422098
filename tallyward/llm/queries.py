"""All queries of this package and their SQL, for the entry point."""

from __future__ import annotations

from tallyward.llm import op1, op10, op11, op12, op13, op2, op3, op4, op5, op6, op7, op8, op9

MODULES = [op1, op10, op2, op3, op4, op5, op6, op7, op8, op9, op11, op12, op13]
QUERIES = {m.NAME: m.query for m in MODULES}
ORACLES = {m.NAME: m.SQL for m in MODULES if getattr(m, "SQL", None)}
