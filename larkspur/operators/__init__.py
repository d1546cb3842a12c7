"""Relational operators that Spark's DataFrames lack, as compositions of those they have."""
