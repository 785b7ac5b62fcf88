"""turnloom: conversation analytics as Spark DataFrame operators."""
