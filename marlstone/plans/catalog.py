"""All queries of the package: importing the query modules fills the registry."""

from . import record, relational, remaining, retrieval, textual  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
