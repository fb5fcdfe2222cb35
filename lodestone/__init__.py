"""lodestone: a PySpark-native engine for memory search, code-quality scoring, agent folds and experiment statistics."""

__version__ = "0.1.0"
