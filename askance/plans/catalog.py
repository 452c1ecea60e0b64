"""All registered queries."""

from . import queries_eval, queries_scoring, queries_text, queries_training, queries_vectors  # noqa: F401
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
