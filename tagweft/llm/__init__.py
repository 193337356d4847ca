"""Training-data operators: one module each, registered by queries.py."""
