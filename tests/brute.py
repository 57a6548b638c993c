"""Plain Python versions of the daily series, for small random tables."""

from __future__ import annotations

from collections import defaultdict


def avg(values):
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


def total(values):
    known = [v for v in values if v is not None]
    return sum(known) if known else None


def divide(a, b):
    return None if a is None or b is None or b == 0 else a / b


def plus(a, b):
    return None if a is None or b is None else a + b


def times(*values):
    out = 1.0
    for v in values:
        if v is None:
            return None
        out *= v
    return out


def first_known(*values):
    return next((v for v in values if v is not None), None)


def fill_rates(rows, rates):
    """Set ``rf`` of rows that are in (day, action) order: one row back, unmatched days last."""
    known = [r for r in rows if r["day"] in rates]
    unknown = [r for r in rows if r["day"] not in rates]
    previous = None
    for row in known + unknown:
        own = rates.get(row["day"])
        row["rf"] = own if own is not None else previous
        previous = own


def actions(dividends):
    groups = defaultdict(list)
    for day, fund, ticker, action, rate, amount in dividends:
        groups[fund, ticker, action].append((day, rate, amount))
    return [
        (min(d for d, _, _ in g), fund, ticker, action, avg([r for _, r, _ in g]), avg([a for _, _, a in g]))
        for (fund, ticker, action), g in groups.items()
    ]


def holding_series(positions, trades, dividends, nav, rates, calendar, start, end):
    held, traded = defaultdict(list), defaultdict(list)
    for day, fund, ticker, asset, shares, price, fx in positions:
        if asset is not None and asset != "OPT":
            held[fund, ticker, day].append((shares, price, fx))
    for day, fund, ticker, asset, kind, shares, price in trades:
        if asset not in (None, "OPT", "CASH") and kind is not None and kind != "SELL (CA.)":
            traded[fund, ticker, day].append((shares, price))
    paid = defaultdict(list)
    for day, fund, ticker, action, rate, amount in actions(dividends):
        paid[fund, ticker, day].append((action, rate, amount))

    histories = defaultdict(list)
    for key in sorted(set(held) | set(traded)):
        fund, ticker, day = key
        net = total([s for s, _ in traded.get(key, [])])
        trade = None if not net else (net, avg([p for _, p in traded[key]]))
        if key not in held and trade is None:
            continue
        base = {"day": day, "shares_traded": trade[0] if trade else 0.0, "trade_price": trade[1] if trade else None}
        if key in held:
            shares, price, fx = (avg(column) for column in zip(*held[key]))
            side = 1 if shares is not None and shares > 0 else -1
            base |= {"side": side, "shares": shares, "price": price, "fx": fx}
            for action, rate, amount in sorted(paid.get(key, [])) or [(None, None, None)]:
                histories[fund, ticker].append(
                    base | {"action": action, "rate": rate or 0.0, "dividends": amount or 0.0}
                )
        else:
            base |= {"side": None, "shares": None, "price": None, "fx": None}
            histories[fund, ticker].append(base | {"action": None, "rate": 0.0, "dividends": 0.0})

    stock = {(day, fund): value for day, fund, value in nav if value}
    out = []
    for (fund, ticker), history in histories.items():
        series, previous = [], {}
        for row in history:
            lag = previous.get
            side = first_known(lag("side"), row["side"])
            shares_0 = first_known(lag("shares"), row["shares_traded"])
            if row["shares"] is None:
                shares_1 = -row["shares_traded"]
            else:
                shares_1 = (row["shares"] - row["shares_traded"]) or row["shares"]
            price_0 = first_known(lag("price"), row["trade_price"])
            price_1 = first_known(row["price"], row["trade_price"])
            value_0 = times(shares_0, price_0, first_known(lag("fx"), row["fx"]))
            fx_1 = first_known(row["fx"], lag("fx"))
            value_1 = times(shares_1, price_1, fx_1)
            with_paid = plus(value_1, row["dividends"])
            if side == 1:
                change, paid_change = divide(value_1, value_0), divide(with_paid, value_0)
            else:
                change, paid_change = divide(value_0, value_1), divide(value_0, with_paid)
            previous = row
            if row["day"] in calendar and start <= row["day"] <= end:
                series.append(
                    {
                        "day": row["day"],
                        "side": side,
                        "price": price_1,
                        "shares": shares_1,
                        "fx": fx_1,
                        "value": value_1,
                        "weight": divide(value_1, stock.get((row["day"], fund))),
                        "yield": divide(row["rate"], price_1),
                        "dividends": row["dividends"],
                        "return": plus(change, -1),
                        "div_return": plus(paid_change, -1),
                    }
                )
        fill_rates(series, rates)
        for r in series:
            xs = None if r["return"] is None or r["rf"] is None else r["return"] - r["rf"]
            xs_div = None if r["div_return"] is None or r["rf"] is None else r["div_return"] - r["rf"]
            out.append(
                (r["day"], fund, ticker, r["side"], r["price"], r["shares"], r["fx"], r["value"], r["weight"],
                 r["yield"], r["dividends"], r["return"], r["div_return"], r["rf"], xs, xs_div)
            )
    return out
