"""Plans and stability scores on Structured Streaming."""
