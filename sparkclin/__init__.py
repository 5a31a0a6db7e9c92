"""sparkclin: clinical risk-data operators as lazy Spark DataFrame jobs.

Every public operator is ``f(df, ...) -> DataFrame``: it only builds a plan,
never collects a data-sized result, and leaves physical choices (scan
pruning, pushdown, join strategy, partial aggregation) to Catalyst and AQE.
"""

from sparkclin.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
