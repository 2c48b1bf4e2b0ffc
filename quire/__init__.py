"""Page and corpus analytics on Spark."""
