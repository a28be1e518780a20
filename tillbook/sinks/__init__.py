"""tillbook.sinks."""
