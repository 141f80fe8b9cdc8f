"""Model-health monitoring on Spark: compare a reference table with a current table."""

from pulsecheck.plans.analysis import Analysis, analyze, analyze_scored
from pulsecheck.sources.pairs import pair_from, pair_of

__all__ = ["Analysis", "analyze", "analyze_scored", "pair_from", "pair_of"]
