"""Training-data operators: one module per operator, plus its thin query."""
