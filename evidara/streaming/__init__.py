"""Optional Structured Streaming forms of three incremental operators.

Each gives the same rows as its batch form once the stream has caught up.
"""
