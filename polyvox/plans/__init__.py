"""Scoring plans: from response sets to curves of surprise."""
