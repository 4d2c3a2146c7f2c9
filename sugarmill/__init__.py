"""Figure-detection, structure and mass analytics as Spark DataFrame operators."""
