"""Column functions: native expressions, one per scalar operator."""
