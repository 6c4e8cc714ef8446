"""ratelens: profiling, repair, feature derivation and rate models for priced shipments.

Every public operator takes and returns a Spark ``DataFrame`` and builds a lazy plan, so
operators chain with ``df.transform(...)``.
"""

from ratelens.errors import ContractError

__all__ = ["ContractError"]
