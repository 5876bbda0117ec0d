"""Column expressions. Nothing in this package starts a job."""
