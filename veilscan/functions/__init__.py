"""Column functions: checks that need no Python, and registration of the scan for SQL."""
