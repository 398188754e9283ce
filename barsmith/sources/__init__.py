"""Where bars come from and where results go."""
