"""Risk and decision analytics on tables, written as Spark DataFrame jobs."""
