"""Column functions: expressions Catalyst compiles, and Arrow functions where none exist."""
