"""Incremental scoring of responses that keep arriving. An extension: the batch operators need none of it."""
