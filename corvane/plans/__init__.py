"""Plans made from rows, recipes and seeded draws."""
