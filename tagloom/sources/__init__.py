"""Readers and writers of alignment files."""
