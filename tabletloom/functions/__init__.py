"""Part of tabletloom."""
