"""Keyed tables on shared storage, and the stores of entity states, messages, checkpoints, traces and performance runs built on them."""
