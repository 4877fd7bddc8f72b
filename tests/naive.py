"""Plain sequential models the Spark operators are compared with."""


class Book:
    def __init__(self):
        self.orders = {}

    def apply(self, e):
        kind, oid = e["event_type"], e["order_id"]
        if kind == "Snapshot":
            if e["flags"] & 1:
                self.orders = {}
            if oid:
                self.orders[oid] = [e["side"], e["price_ticks"], e["quantity"]]
        elif kind == "Add":
            self.orders[oid] = [e["side"], e["price_ticks"], e["quantity"]]
        elif kind == "Replace" and oid in self.orders:
            side = self.orders.pop(oid)[0]
            self.orders[oid] = [side, e["price_ticks"], e["quantity"]]
        elif kind in ("Cancel", "Execute") and oid in self.orders:
            left = self.orders[oid][2] - e["quantity"]
            if left <= 0 or (kind == "Cancel" and e["quantity"] == 0):
                del self.orders[oid]
            else:
                self.orders[oid][2] = left

    def levels(self):
        out = {}
        for side, price, quantity in self.orders.values():
            out[(side, price)] = out.get((side, price), 0) + quantity
        return out

    def top(self):
        bids = {p: q for (s, p), q in self.levels().items() if s == "Buy"}
        asks = {p: q for (s, p), q in self.levels().items() if s == "Sell"}
        bid, ask = max(bids, default=None), min(asks, default=None)
        return bid, bids.get(bid), ask, asks.get(ask)


def random_flow(rng, symbols=2, events=300, snapshots=True):
    """Valid random event rows with partial cancels, replaces and snapshot blocks."""
    rows = []
    for symbol in range(1, symbols + 1):
        book, next_id = Book(), symbol * 10_000
        for n in range(1, events + 1):
            e = {"order_id": 0, "side": "None", "price_ticks": 0, "quantity": 0, "flags": 0}
            live = list(book.orders)
            pick = rng.random()
            if snapshots and pick < 0.02:
                e |= {"event_type": "Snapshot", "flags": 1}
                if rng.random() < 0.5:
                    next_id += 1
                    e |= {"order_id": next_id, "side": "Buy", "price_ticks": 95, "quantity": 7}
            elif pick < 0.5 or not live:
                next_id += 1
                side = rng.choice(["Buy", "Sell"])
                away = rng.randint(1, 8)
                e |= {
                    "event_type": "Add", "order_id": next_id, "side": side,
                    "price_ticks": 100 - away if side == "Buy" else 100 + away,
                    "quantity": rng.randint(1, 50),
                }
            else:
                oid = rng.choice(live)
                side, price, quantity = book.orders[oid]
                e |= {"order_id": oid, "side": side, "price_ticks": price}
                if pick < 0.65:
                    e |= {"event_type": "Execute", "quantity": rng.randint(1, quantity)}
                elif pick < 0.75:
                    e |= {"event_type": "Cancel", "quantity": 0}
                elif pick < 0.85:
                    e |= {"event_type": "Cancel", "quantity": rng.randint(1, quantity)}
                elif pick < 0.95:
                    away = rng.randint(1, 8)
                    e |= {
                        "event_type": "Replace", "quantity": rng.randint(1, 60),
                        "price_ticks": 100 - away if side == "Buy" else 100 + away,
                    }
                else:
                    e |= {"event_type": "Trade", "order_id": 0, "quantity": 1}
            book.apply(e)
            rows.append(
                (
                    n, n, symbol, e["event_type"], e["side"], e["price_ticks"], e["quantity"],
                    e["order_id"], 0, e["flags"],
                )
            )
    return rows
