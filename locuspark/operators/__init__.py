"""Operators on sequences, loci, genotypes and graphs."""
