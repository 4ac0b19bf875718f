"""Column functions and Arrow functions on text, numbers and vectors."""
