"""Readers and writers, and adapters from tables to files, chunks and vectors."""
