"""Writers of lines, baskets, runs, recommendations and orders."""
