"""The operators wired to the driver's tables, each with its equivalent SQL."""
