"""Column functions and the tag sets they use."""
