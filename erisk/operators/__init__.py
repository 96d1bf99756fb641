"""DataFrame -> DataFrame operators. Each keeps every row and splits hot keys."""
