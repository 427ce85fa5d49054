"""Document and line-item analytics as DataFrame transforms on Spark."""
