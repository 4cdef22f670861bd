"""Agent-session analytics as Spark DataFrame operators."""
