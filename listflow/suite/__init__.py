"""The operators bound to the driver tables, each beside its SQL oracle."""

from listflow.suite import keys, words, facets, people, feeds, streams  # noqa: F401
from listflow.suite.registry import OPERATORS, ORACLES, QUERIES  # noqa: F401
