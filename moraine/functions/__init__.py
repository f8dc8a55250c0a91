"""Column functions: one for each scalar rule, all of built-in expressions."""

from . import geometry, names, rules, stats  # noqa: F401
