"""Multi-step plans: generations, phases, permutation tests."""
