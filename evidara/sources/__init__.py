"""Readers: files, readings and model payloads."""
