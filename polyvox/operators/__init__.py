"""Operators over response sets, curves and scores."""
