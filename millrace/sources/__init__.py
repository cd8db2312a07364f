"""Reading tables and streams, and keeping intermediate results in shared storage."""
