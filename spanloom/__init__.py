"""spanloom: a PySpark-native engine for temporal knowledge graphs and training-data preparation."""
