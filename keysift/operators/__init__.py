"""DataFrame transformations, one module per kind of work."""
