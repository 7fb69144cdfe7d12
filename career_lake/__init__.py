"""career_lake: recruitment-data analytics as Spark DataFrame jobs."""
