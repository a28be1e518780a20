"""tillbook.sources."""
