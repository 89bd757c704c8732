"""Point-in-time commerce analytics and corpus preparation as Spark DataFrame jobs."""
