"""All queries of the engine."""

from . import analytics, finance, listings, mechanisms, people, reviews, rules, texts, timeline, upkeep, versions  # noqa: F401  (each registers its queries)
from .registry import ORACLES, QUERIES  # noqa: F401
