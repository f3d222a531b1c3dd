"""Part of arborlens."""
