"""The archive's orders against a plain sort."""

from __future__ import annotations

import datetime
import random

import pytest

from tidemark.operators import matching as J

SHAPE = "id long, sent_at timestamp, symbol string, interval string, confidence int, status string, best_return double, worst_return double"


@pytest.mark.parametrize("sort", [*J.SORTS, "nonsense", None])
def test_archive_order(spark, sort):
    r, at = random.Random(3), datetime.datetime(2020, 1, 1)
    rows = [(i, at + datetime.timedelta(days=r.randint(0, 9)), r.choice("AB"), r.choice(["1d", "1wk"]), r.choice([None, 50, 60]), r.choice("XY"), r.choice([None, 1.0, 2.0]), r.choice([None, -1.0])) for i in range(70)]
    names = [x.split()[0] for x in SHAPE.split(", ")]
    column = names.index(J.SORTS.get(sort, "sent_at"))
    for way in ("asc", "DESC", None):
        up = way == "asc"
        want = sorted(rows, key=lambda x: (x[1], x[0]), reverse=True)
        if column == 1:
            want = sorted(rows, key=lambda x: (x[1], x[0]), reverse=not up)
        else:
            held = [x for x in want if x[column] is not None]
            # a stable sort; reversed values keep the order of equal ones
            held = sorted(held, key=lambda x: x[column]) if up else [x for v in sorted({x[column] for x in held}, reverse=True) for x in held if x[column] == v]
            want = held + [x for x in want if x[column] is None]
        got = J.archive_page(spark.createDataFrame(rows, SHAPE), sort, way, 1, 20).orderBy("place").collect()
        assert [x.id for x in got] == [x[0] for x in want[20:40]]
        assert [x.place for x in got] == list(range(21, 41))
