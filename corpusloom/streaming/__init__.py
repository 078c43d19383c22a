"""The row-local transforms on streams."""
