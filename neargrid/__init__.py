"""A Spark-first engine that scores transactions by their nearest labelled neighbours."""
