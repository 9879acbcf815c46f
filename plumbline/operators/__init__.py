"""Relational operators: matching, quality, rasters, ordered tracks, decisions, estimation."""
