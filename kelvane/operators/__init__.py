"""The engine's operators beyond relational SQL: graph patterns, writes, security, data API, jobs."""
