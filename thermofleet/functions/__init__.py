"""Column functions: everything here builds Catalyst expressions, nothing runs Python per row."""
