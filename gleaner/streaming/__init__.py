"""The extractor on streams of pages."""
