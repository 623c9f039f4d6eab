"""Messages for tests."""

from __future__ import annotations

import datetime as dt

from parley.schema import MESSAGES

T0 = dt.datetime(2024, 1, 1, 9, 0)


def message(n, minutes=0.0, sender="a", chat="c", kind="group", text=None, type_="text", reply=None, account="acct", name="Room"):
    at = T0 + dt.timedelta(minutes=minutes)
    return (account, chat, name, kind, f"{chat}-{n}", sender, sender, at, f"text {n}" if text is None else text, type_, reply)


def frame(spark, rows):
    return spark.createDataFrame(rows, MESSAGES)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
