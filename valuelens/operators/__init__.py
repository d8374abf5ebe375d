"""DataFrame operators (see README for the operator inventory)."""
