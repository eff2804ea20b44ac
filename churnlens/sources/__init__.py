"""Sources, sinks and data-quality gates."""
