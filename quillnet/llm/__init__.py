"""Training-data operators. Nothing else in quillnet imports this package."""
