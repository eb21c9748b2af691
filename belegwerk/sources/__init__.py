"""Readers and writers: document folders, model tables."""
