"""Readers of exports, boundaries and photo folders; small stores; sinks."""
