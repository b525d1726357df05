"""The parsers on streams."""
