"""Readers and adapters of log lines, samples and resources."""
