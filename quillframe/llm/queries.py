"""All queries of this subpackage; importing an operator registers its own."""

from __future__ import annotations

from quillframe.llm import (
    chat,
    decontaminate,
    fingerprints,
    lexical,
    mixture,
    quality,
    secrets,
    simhash,
    spelling,
    suffixes,
    templates,
    tokens,
    toxicity,
)
from quillframe.llm.common import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "chat",
    "decontaminate",
    "fingerprints",
    "lexical",
    "mixture",
    "quality",
    "secrets",
    "simhash",
    "spelling",
    "suffixes",
    "templates",
    "tokens",
    "toxicity",
]
