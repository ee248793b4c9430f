"""Event-pattern detection and corpus preparation on PySpark."""
