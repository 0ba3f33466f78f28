"""Column expressions: names and types, classifiers, point rules."""
