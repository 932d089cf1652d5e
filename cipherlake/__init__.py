"""A lazily planned cryptography inventory and migration analytics engine on Spark."""
