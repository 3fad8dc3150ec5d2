"""Training-data operators. Nothing outside this folder imports it; see `queries` for what it registers."""
