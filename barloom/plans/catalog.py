"""Importing the query modules fills the registry."""

from barloom.plans import q_book, q_extra, q_features, q_labels, q_ml, q_portfolio, q_recursive, q_rules, q_signals, q_sources, q_streaming, q_studies, q_trades  # noqa: F401
from barloom.plans.registry import ORACLES, QUERIES  # noqa: F401
