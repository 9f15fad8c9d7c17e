"""Stage composition and the registered queries."""
