"""State engine for time-ordered observation streams, on PySpark."""
