"""Registered queries: input adapters, Spark callables and their SQL counterparts."""
