"""Analyses over feed-shaped DataFrames."""
