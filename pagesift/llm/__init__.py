"""Training-data operators: one module per operator, thin queries in ``queries``."""
