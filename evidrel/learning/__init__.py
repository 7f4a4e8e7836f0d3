"""Learned models: hashed features, distributed SGD, a linear-chain field, rankers."""
