"""Reading, recognising, writing and staging tables."""
