"""From a parsed scenario to a resolved plan: names, types, lineage, keys and proofs, before anything runs."""

from layerloom.plans.resolve import resolve
from layerloom.plans.resolved import Link, ResolvedPlan

__all__ = ["Link", "ResolvedPlan", "resolve"]
