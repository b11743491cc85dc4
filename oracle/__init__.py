"""SQL statements that an independent engine runs on the same tables, to compare results with."""
