"""tillbook.plans."""
