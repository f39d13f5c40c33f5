"""Registered queries: each name has a Spark form and, where SQL can say it, a checking SQL."""
