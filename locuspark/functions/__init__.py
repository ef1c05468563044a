"""Column functions on nucleotide sequences and quality strings."""
