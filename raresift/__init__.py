"""raresift: find rare classes in very large labelled catalogues with Spark."""
