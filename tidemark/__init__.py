"""Weekly evidence analytics on Spark."""
