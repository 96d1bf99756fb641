"""Column expressions: no shuffles, no Python in the tasks."""
