"""Column expressions: predicates, codes and measures."""
