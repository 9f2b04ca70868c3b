"""Graph operators as DataFrame programs."""
