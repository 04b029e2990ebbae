"""signalmill: growth-signal analytics as PySpark DataFrame operators."""
