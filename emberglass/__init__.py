"""Rule evaluation, event investigation and training-data operators on PySpark."""
