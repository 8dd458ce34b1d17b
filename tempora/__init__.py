"""tempora: Spark-first analytics for detection streams and event signals."""
