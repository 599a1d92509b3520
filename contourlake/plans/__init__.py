"""Composed plans: derived inputs, the whole vectorisation, and exports."""
