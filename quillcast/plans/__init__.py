"""The registered queries of the library."""

from . import articles, batches, corpus, forecasts, outcomes, stored, tagged  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
