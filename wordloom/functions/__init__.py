"""Column functions: text, numbers and repeatable randomness."""
