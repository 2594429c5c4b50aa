"""wayfold: decision-trajectory analytics as declarative Spark DataFrame plans."""
