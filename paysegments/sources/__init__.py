"""Inputs: the payments fact and the segment lookup."""
