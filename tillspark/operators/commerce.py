"""Carts and orders, for many carts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.runtime import salted_join


def priced_carts(carts: DataFrame, products: DataFrame) -> DataFrame:
    """Cart lines with price and subtotal; products not in ``products`` are dropped."""
    prices = products.select(F.col("name").alias("product"), "price")
    return salted_join(carts, prices, ["product"], ["cart_id"]).select(
        "cart_id", "product", "qty", "price", (F.col("price") * F.col("qty")).alias("subtotal")
    )


def cart_totals(carts: DataFrame, products: DataFrame) -> DataFrame:
    """Items in each cart, and what its known products cost.

    The total is summed in decimals, so it does not depend on the order of the lines.
    """
    prices = products.select(F.col("name").alias("product"), F.col("price").cast("decimal(28,8)"))
    return (
        salted_join(carts, prices, ["product"], ["cart_id"], "left")
        .groupBy("cart_id")
        .agg(
            F.sum("qty").alias("cart_count"),
            F.coalesce(F.sum(F.col("price") * F.col("qty").cast("decimal(10,0)")).cast("double"),
                       F.lit(0.0)).alias("cart_total"),
        )
    )


def order_number(cart_id: Column) -> Column:
    """A stable number to show, made from 128 bits of a hash of the cart. Tables are joined on cart_id."""
    return F.concat(F.lit("ORD-"), F.upper(F.md5(cart_id.cast("string"))))


def order_headers(
    carts: DataFrame, products: DataFrame, customers: DataFrame
) -> DataFrame:
    """One completed order per non-empty cart whose customer gave a name.

    ``customers`` has cart_id, customer_name, customer_email and created_at.
    """
    named = customers.filter(F.col("customer_name").isNotNull() & (F.col("customer_name") != ""))
    return cart_totals(carts, products).join(named, "cart_id").select(
        "cart_id", order_number(F.col("cart_id")).alias("order_number"), "customer_name",
        "customer_email", F.col("cart_total").alias("total_amount"),
        F.lit("completed").alias("status"), "created_at",
    )


def order_lines(carts: DataFrame, products: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines of those orders with the price at purchase."""
    orders = headers.select("cart_id", "order_number")
    return priced_carts(carts, products).join(orders, "cart_id").select(
        "cart_id", "order_number", "product", F.col("qty").alias("quantity"), "price"
    )


def order_details(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Order lines with their order."""
    keep = headers.select("cart_id", "customer_name", "status", "total_amount")
    return lines.join(keep, "cart_id")


#: Edits meet in groups of at most so many consecutive numbers (2 to these powers), then groups of groups, then keys.
RANGES = (16, 32)


def _edit(action: Column, qty: Column) -> Column:
    """What one event does to the quantity of a product, as a function.

    ``absent`` is the quantity of a product that was not in the cart (NULL: still not); one that was goes if ``gone``, and has
    ``base`` (NULL: what it had) and ``plus`` otherwise. An unknown action, or a set without quantity, changes nothing.
    """
    adds, none = action == "add", F.lit(None).cast("long")
    deletes = F.coalesce((action == "remove") | ((action == "set") & (qty <= 0)), F.lit(False))
    return F.struct(
        F.when(adds, F.lit(1).cast("long")).otherwise(none).alias("absent"), deletes.alias("gone"),
        F.when((action == "set") & (qty > 0), qty.cast("long")).otherwise(none).alias("base"),
        F.when(adds, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")).alias("plus"),
    )


def _on(edit: Column, qty: Column) -> Column:
    """The quantity of a product in the cart after the edit; NULL if it goes."""
    return F.when(~edit["gone"], F.coalesce(edit["base"], qty) + edit["plus"])


def _then(first: Column, second: Column) -> Column:
    """Both edits as one. This is associative, so runs of edits can be composed apart and put together in order."""
    gone = F.when(first["gone"], second["absent"].isNull()).otherwise(second["gone"])
    fixed = F.when(first["gone"], second["absent"]).otherwise(F.coalesce(second["base"], first["base"]))
    plus = F.when(first["gone"], F.lit(0).cast("long")).when(second["base"].isNotNull(), second["plus"]).otherwise(first["plus"] + second["plus"])
    return F.struct(
        F.when(first["absent"].isNull(), second["absent"]).otherwise(_on(second, first["absent"])).alias("absent"),
        gone.alias("gone"), fixed.alias("base"), plus.alias("plus"),
    )


def cart_edits(events: DataFrame) -> DataFrame:
    """(cart_id, product, edit): all events of a product in a cart, by ``seq``, composed into one function.

    One scan. A key's events are cut into ranges of ``seq``, so that no task sorts more than a range of a hot key; what a range
    sends on is one function. Events with equal ``seq`` are taken in the order of what they do.
    """
    keys, seq = ["cart_id", "product"], F.col("seq").cast("long")
    rows = events.select(*keys, seq.alias("at"), _edit(F.col("action"), F.col("qty")).alias("edit"))
    nothing = F.lit(None).cast("struct<absent:bigint,gone:boolean,base:bigint,plus:bigint>")
    for below, bits in zip((0, *RANGES), (*RANGES, None)):
        place = [] if bits is None else [F.shiftright("at", bits - below).alias("at")]
        run = F.sort_array(F.collect_list(F.struct("at", "edit")))
        grouped = rows.select(*keys, *(p.alias("range") for p in place), "at", "edit").groupBy(*keys, *(["range"] if place else [])).agg(run.alias("run"))
        whole = F.aggregate("run", nothing, lambda done, e: F.when(done.isNull(), e["edit"]).otherwise(_then(done, e["edit"])))
        rows = grouped.select(*keys, *([F.col("range").alias("at")] if place else []), whole.alias("edit"))
    return rows


def fold_cart_events(events: DataFrame) -> DataFrame:
    """Final carts from edits ordered by ``seq``: add is +1, set replaces, set <= 0 and remove delete.

    Setting or removing a product that is not in the cart does nothing.
    """
    done = cart_edits(events)
    return done.filter("edit.absent IS NOT NULL").select("cart_id", "product", F.col("edit.absent").alias("qty"))


def apply_edits(carts: DataFrame, edits: DataFrame) -> DataFrame:
    """Carts (cart_id, product, qty) after the ``edits`` of ``cart_edits``."""
    after = F.when(F.col("edit").isNull(), F.col("qty")).when(F.col("qty").isNull(), F.col("edit.absent")).otherwise(_on(F.col("edit"), F.col("qty")))
    return carts.join(edits, ["cart_id", "product"], "full_outer").select("cart_id", "product", after.alias("qty")).filter("qty IS NOT NULL")
