"""DataFrame → DataFrame operators, grouped by kind."""
