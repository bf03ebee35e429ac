"""Reading corpora, and writing and reading what the jobs produce."""
