"""Micro-batch sinks with resume cursors."""
