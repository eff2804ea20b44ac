"""DataFrame operators: ``DataFrame (+ params) -> DataFrame``."""
