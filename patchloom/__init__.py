"""A PySpark engine for mining, comparing, slicing and ranking change records."""
