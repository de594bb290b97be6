"""sheafline: retrieval analytics as Spark DataFrame queries."""
