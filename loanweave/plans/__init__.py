"""Ready-made plans: the portfolio built from a star schema, and the registered queries."""
