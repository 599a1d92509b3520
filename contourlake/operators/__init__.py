"""Operators on tables of pixels, masks, segments, paths and layers."""
