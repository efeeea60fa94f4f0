"""Registered queries: importing the modules fills the catalog."""

from passagelake.plans import answers, messages, passages, stored, vectors  # noqa: F401
from passagelake.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
