"""Column-level building blocks (pure ``Column -> Column`` helpers) and the
distributed prefix-sum helper."""
