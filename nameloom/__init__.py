"""Release-name analytics on Spark."""
