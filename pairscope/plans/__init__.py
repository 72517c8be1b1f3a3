"""Plans of the paired-evaluation engine."""
