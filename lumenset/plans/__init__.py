"""The staged pipeline, and the registered queries with their SQL."""
