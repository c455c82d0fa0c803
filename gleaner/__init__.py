"""Web-page content extraction and corpus building on Spark."""
