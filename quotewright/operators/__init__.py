"""Relational operators over event streams, books, queues, fills and runs."""
