"""The feedback loop between a quoting strategy and a simulated exchange, and experiments over it."""
