"""Readers and writers of snapshots and dictionaries."""
