"""Entry points that plan whole analyses, and the queries over the driver tables."""
