"""Operators combined into whole jobs."""
