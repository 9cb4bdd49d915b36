"""The registered queries over the order tables, and SQL that recomputes each of them."""
