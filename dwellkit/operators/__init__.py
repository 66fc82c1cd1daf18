"""DataFrame-to-DataFrame operators; callers pass column names."""
