"""PySpark engine for health, climate and environment data."""
