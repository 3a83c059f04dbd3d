"""Column functions: safe arithmetic, rectifiers, labels."""
