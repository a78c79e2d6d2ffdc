"""Fitted steps, plans made of them, and the preparation flows that produce plans."""
