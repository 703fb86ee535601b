"""A PySpark-native engine for rule-driven analytics over payment-flow facts."""
