"""Detection rules as data: model, checks, and the shipped catalogue."""

from embertrace.rules.model import Condition, Rule
from embertrace.rules.catalogue import catalogue

__all__ = ["Condition", "Rule", "catalogue"]
