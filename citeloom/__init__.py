"""Citation analytics, retrieval and corpus preparation as Spark DataFrame programs."""
