"""Suggestions for carts as their events arrive.

The carts are the state of a stateful operator: one entry of the state store per cart. A micro-batch reads and writes the entries
of the carts it touches, whatever the number of carts stored, and hands on what these now hold. Recommendations are a
static table. State stores keep their versions under the query's checkpoint folder, so a batch that is run again
starts from the state before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tillspark.operators.recommend import cross_sell
from tillspark.runtime import materialize, scratch

#: A cart with what is in it; one row with a NULL product if that is nothing.
CARTS = "cart_id string, product string, qty long"
STATE = "products array<string>, quantities array<bigint>"


def after_events(cart: dict[str, int], events: Iterator[tuple]) -> dict[str, int]:
    """``cart`` after edits (seq, action, product, qty), one after the other. Unknown actions change nothing."""
    for _, action, product, qty in events:
        if action == "add":
            cart[product] = cart.get(product, 0) + 1
        elif product in cart and action == "remove":
            del cart[product]
        elif product in cart and action == "set" and qty == qty and qty is not None:
            if qty > 0:
                cart[product] = int(qty)
            else:
                del cart[product]
    return cart


def _keeper(idle_ms: int | None):
    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cart = dict(zip(*state.get)) if state.exists and not state.hasTimedOut else {}
        # The events of one cart in one batch.
        events = sorted((e for f in frames for e in f[["seq", "action", "product", "qty"]].itertuples(index=False, name=None)), key=lambda e: e[0])
        after_events(cart, events)
        if cart:
            state.update((list(cart), list(cart.values())))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"cart_id": key[0], "product": list(cart) or [None], "qty": pd.array(list(cart.values()) or [None], "Int64")})

    return keep


def live_carts(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream of ``CARTS``: what each cart holds that a batch of ``events`` (cart_id, seq, action, product, qty) touches.

    Events of a cart must arrive in the order of their batches; within a batch they are taken by ``seq``. A cart without events for
    ``idle_ms`` is given up and handed on as empty. Memory: the events of one cart in one batch, and the cart.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    rows = events.select("cart_id", "seq", "action", "product", F.col("qty").cast("double").alias("qty"))
    return rows.groupBy("cart_id").applyInPandasWithState(_keeper(idle_ms), CARTS, STATE, "update", timeout)


def _start(stream: DataFrame, each, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _write_batch(rows: DataFrame, batch_id: int, out_path: str) -> None:
    """A batch that is run again overwrites what it wrote."""
    (
        rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch").parquet(out_path)
    )


def store_live_carts(
    events: DataFrame, out_path: str, checkpoint: str, idle_ms: int | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Start a query that writes every touched cart to ``out_path``; ``latest`` reads what holds."""
    return _start(live_carts(events, idle_ms), lambda carts, batch_id: _write_batch(carts, batch_id, out_path), checkpoint, trigger)


def suggest_live(
    events: DataFrame, recs: DataFrame, out_path: str, checkpoint: str, n: int = 5, idle_ms: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a query that keeps ``out_path`` (batch, cart_id, product, score, rank) up to date.

    Each cart a batch touches gets rows of that batch; one without suggestions gets a row with a NULL product, so
    that earlier ones no longer hold. ``latest_suggestions`` reads what holds.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            # Stored first: the state must be worked out once per batch.
            carts = materialize(batch)
            found = cross_sell(carts.filter("product IS NOT NULL"), recs, n)
            _write_batch(carts.select("cart_id").distinct().join(found, "cart_id", "left"), batch_id, out_path)

    return _start(live_carts(events, idle_ms), each, checkpoint, trigger)


def latest(rows: DataFrame) -> DataFrame:
    """The rows that hold: those of each cart's last batch, without the ones that only say there are none."""
    last = W.partitionBy("cart_id").orderBy(F.desc("batch"))
    held = rows.withColumn("_age", F.rank().over(last)).filter("_age = 1 AND product IS NOT NULL")
    return held.drop("_age")


latest_suggestions = latest


import sys  # noqa: E402

# The function that keeps a cart travels with the job; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
