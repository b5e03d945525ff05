"""Column expressions: built-in functions only, so that they stay inside generated code and push down."""
