"""docmill.functions."""
