"""Where documents come from and where rows go."""
