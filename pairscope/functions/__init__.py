"""Functions of the paired-evaluation engine."""
