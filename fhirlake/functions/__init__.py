"""Column-level building blocks: paths, dates, classifiers and the fixed rule values."""
