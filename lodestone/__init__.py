"""A PySpark-native engine for memory, safety and knowledge-graph analytics."""
