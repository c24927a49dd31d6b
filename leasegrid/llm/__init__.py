"""Training-data operators: one module each, every one with its registered query in ``queries``."""
