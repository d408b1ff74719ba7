"""Named marts and jobs composed from the operators."""
