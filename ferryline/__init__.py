"""Move, replicate and reconcile relational data with Spark."""
