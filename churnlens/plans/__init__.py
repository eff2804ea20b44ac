"""Named query plans over the driver tables (``queries``) and their SQL oracles."""
