"""Column expressions: CIGAR arithmetic, edit distances, flags, text."""
