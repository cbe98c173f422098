"""Query of the language model; tested against a plain count and by held-out accuracy."""

from __future__ import annotations

from tallyward.llm import suffixtree
from tallyward.sources.tables import load

NAME = "op4_lm_scoring"


def query(spark, folder):
    return suffixtree.scored(load(spark, folder, "documents"))
