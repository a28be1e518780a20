"""tillbook.operators."""
