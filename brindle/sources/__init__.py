"""Readers and writers: files, documents, remote pages."""
