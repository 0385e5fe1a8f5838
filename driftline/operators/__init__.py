"""DataFrame operators over haplotypes, variants, demes, edges and statistics."""
