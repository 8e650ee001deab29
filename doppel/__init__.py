"""doppel: duplicate-person resolution as Spark DataFrame jobs."""
