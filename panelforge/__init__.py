"""A Spark engine for factor analytics over dense, mask-aware (date, instrument) panels."""
