"""Readers and writers for documents, transcripts and JSON files."""
