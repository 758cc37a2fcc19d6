"""Readers and writers: event logs, corpora, versioned indexes."""
