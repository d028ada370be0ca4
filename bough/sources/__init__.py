"""Where levels and code lists come from."""
