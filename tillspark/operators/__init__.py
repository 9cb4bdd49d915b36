"""DataFrame-to-DataFrame operators over retail lines, baskets, rules and carts."""
