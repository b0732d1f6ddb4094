"""A PySpark-native engine for ordered time series, panels and their models."""
