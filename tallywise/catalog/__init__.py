"""All registered queries; importing the package fills the registry."""

from . import findings, groups, profiles, questions, series, sources, starts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
