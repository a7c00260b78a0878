"""reelspark: recommender data jobs expressed as Spark DataFrame plans.

Every public operator is a function ``DataFrame(s) -> DataFrame`` with keyword
parameters. Operators never collect unbounded data, never write, and never
create a session; the few that need a bounded driver-side value (a list of
range bounds, a partition count) say so in their docstring.
"""

from reelspark.session import build_session, checkpoint_dir  # noqa: F401

__all__ = ["build_session", "checkpoint_dir"]
