"""Query modules: each has queries() and oracle_sql()."""
