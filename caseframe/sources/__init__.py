"""Where tables come from, and where results and intermediate tables go."""
