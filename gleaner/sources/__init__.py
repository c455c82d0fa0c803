"""Readers and writers of pages, gold texts and gold blocks."""
