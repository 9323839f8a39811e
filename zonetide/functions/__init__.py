"""Column-in, Column-out functions; every one compiles to built-in expressions."""
