"""tillbook.streaming."""
