"""Readers and writers of graph files and run artifacts."""
