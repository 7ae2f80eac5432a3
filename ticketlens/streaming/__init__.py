"""Tickets that keep arriving, through the same models as the batch run."""
