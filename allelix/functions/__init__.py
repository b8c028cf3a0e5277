"""Column functions: identifiers, ratios, chromosome names and the exact binomial tail."""
