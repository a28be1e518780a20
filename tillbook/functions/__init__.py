"""tillbook.functions."""
