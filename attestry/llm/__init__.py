"""Training-data operators: one module an operator, and the queries over the driver's tables."""
