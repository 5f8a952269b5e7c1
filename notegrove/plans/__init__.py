"""Index maintenance, the engine and its command line."""
