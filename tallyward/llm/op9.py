"""Query of the fingerprints; tested against plain sets."""

from __future__ import annotations

from tallyward.llm import fingerprints
from tallyward.sources.tables import load

NAME = "op9_fingerprints"


def query(spark, folder):
    return fingerprints.fingerprinted(load(spark, folder, "documents"))
