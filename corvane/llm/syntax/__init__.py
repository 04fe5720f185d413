"""Recursive-descent syntax checkers with precedence-climbing expressions and panic-mode recovery."""

from .check import LANGUAGES, Verdict, check

__all__ = ["LANGUAGES", "Verdict", "check"]
