"""Case curves and snapshots kept up to date with Structured Streaming."""
