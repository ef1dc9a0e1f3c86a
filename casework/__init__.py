"""Policy-driven support casework as set-at-a-time Spark operators."""
