"""Reading observation tables and result tables, writing results, shared storage."""
