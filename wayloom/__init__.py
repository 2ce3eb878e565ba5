"""wayloom: a PySpark-native engine for multimodal route planning and its data."""
