"""churnlens — budget-constrained retention analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame (+ parameters) -> DataFrame``. Scalars are
returned as one-row DataFrames; nothing customer-sized is collected to the driver.
"""

from churnlens.session import ensure_checkpoint_dir, get_spark

__all__ = ["get_spark", "ensure_checkpoint_dir"]
