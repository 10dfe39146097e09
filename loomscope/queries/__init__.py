"""Registered queries of the evaluation and curation operators, with their SQL side by side."""

from loomscope.queries import agents, choices, conversations, episodes, grounding, pictures, texts  # noqa: F401
from loomscope.queries.registry import ORACLES, QUERIES  # noqa: F401
