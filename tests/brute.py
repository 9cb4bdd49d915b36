"""Plain Python counting over small baskets, sharing nothing with the library."""

from fractions import Fraction
from itertools import combinations


def itemsets(baskets, support: str, max_len=None):
    baskets = [set(b) for b in baskets]
    least = Fraction(support) * len(baskets)
    items = sorted(set().union(*baskets)) if baskets else []
    found = {}
    for k in range(1, (max_len or len(items)) + 1):
        level = {}
        for c in combinations(items, k):
            n = sum(1 for b in baskets if b.issuperset(c))
            if n and n >= least:
                level[c] = n
        if not level:
            break
        found.update(level)
    return found


def rules(sets, n, confidence):
    out = {}
    for s, f in sets.items():
        for k in range(1, len(s)):
            for a in combinations(s, k):
                c = tuple(x for x in s if x not in a)
                conf = f / sets[a]
                if conf >= confidence:
                    out[(a, c)] = (conf, f / n, conf / (sets[c] / n))
    return out


def fold(events):
    """Apply cart events one after the other."""
    carts = {}
    for cart, _, action, product, qty in sorted(events, key=lambda e: e[1]):
        c = carts.setdefault(cart, {})
        if action == "add":
            c[product] = c.get(product, 0) + 1
        elif product in c:
            if action == "remove" or qty <= 0:
                del c[product]
            else:
                c[product] = qty
    return {(cart, p): q for cart, c in carts.items() for p, q in c.items()}
