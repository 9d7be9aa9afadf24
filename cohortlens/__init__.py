"""Statistics and model validation for wide tabular studies, as Spark DataFrame jobs."""
