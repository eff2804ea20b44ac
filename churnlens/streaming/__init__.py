"""Structured Streaming: score new account records per micro-batch and report drift."""
