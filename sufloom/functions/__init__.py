"""Column expressions over DNA texts."""
