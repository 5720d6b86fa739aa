"""Column expressions. Nothing in here reads data or starts a job."""
