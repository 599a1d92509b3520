"""Images, keyed stores and settings as tables."""
