"""Statistical procedures; each takes a DataFrame and returns a flat, typed DataFrame."""
