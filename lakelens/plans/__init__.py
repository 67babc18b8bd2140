"""Queries over the driver tables; importing the modules below registers them."""
