"""Graph operators as Catalyst plans."""
