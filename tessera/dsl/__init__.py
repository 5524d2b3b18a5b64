"""The factor expression language: syntax tree, parser, limits, identity and a random sampler."""

from .ast import Call, Constant, ExpressionError, Feature, Window, canonical, expression_hash, family, lookback, measure
from .parser import parse, parse_tagged
from .sampler import sample
from .vocabulary import CONSTANTS, FEATURES, OPERATORS, WINDOWS

__all__ = ["CONSTANTS", "FEATURES", "OPERATORS", "WINDOWS", "Call", "Constant", "ExpressionError", "Feature", "Window", "canonical", "expression_hash", "family", "lookback", "measure", "parse", "parse_tagged", "sample"]
