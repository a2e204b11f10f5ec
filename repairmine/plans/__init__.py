"""Registered queries. Importing this package fills the registry."""

from repairmine.plans import corruption, mining, relational, storage, streams, text, vocabulary, weeks  # noqa: F401
from repairmine.plans.registry import ORACLES, QUERIES  # noqa: F401
