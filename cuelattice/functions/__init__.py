"""Column functions: scalar laws, text rules and keyed draws."""
