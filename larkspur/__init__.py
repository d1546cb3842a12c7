"""larkspur: a PySpark-native analytical query engine with PostgreSQL semantics."""
