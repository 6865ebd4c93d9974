"""Streams of job items: the latest state of each, progress, and gated results."""
