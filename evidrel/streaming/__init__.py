"""Incremental use of the batch operators; the operators themselves are not stateful."""
