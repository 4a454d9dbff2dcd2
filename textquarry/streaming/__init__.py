"""Structured Streaming jobs that append exactly once and resume from a checkpoint."""
