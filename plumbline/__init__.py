"""Profile, check and explore tables with Spark."""
