"""timelode: time-coded media knowledge bases as Spark DataFrame jobs."""
