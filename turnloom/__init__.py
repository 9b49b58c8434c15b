"""turnloom: a PySpark-native engine for curating multi-turn dialogue data."""
