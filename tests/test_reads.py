"""Pages by cursor: nothing is lost or shown twice, and a foreign cursor is refused."""

import datetime
import random

import pytest

from tidemark.operators import reads as A


def test_pages_cover_all_rows(spark):
    r = random.Random(4)
    rows = [(datetime.date(2024, 1, 1) + datetime.timedelta(days=7 * r.randint(0, 3)), i, r.randint(0, 4)) for i in range(53)]
    df = spark.createDataFrame(rows, "week date, post_id long, likes long")
    asked, after, seen = {"limit": 10, "q": "x"}, None, []
    while True:
        page, more = A.has_more(A.feed(df, limit=10, after=after).collect(), 10)
        seen += [(x.week, x.likes, x.post_id) for x in page]
        if not more:
            break
        after = A.resumed(A.token("feed", asked, [page[-1].week, page[-1].likes, page[-1].post_id]), "feed", asked, 3)
    assert seen == sorted(((w, n, i) for w, i, n in rows), key=lambda x: (-x[0].toordinal(), -x[1], x[2]))
    # a row that comes before a page does not move it
    grown = df.unionByName(spark.createDataFrame([(datetime.date(2025, 1, 6), 999, 1)], df.schema))
    assert [x.post_id for x in A.feed(grown, limit=10, after=list(seen[9])).collect()] == [x[2] for x in seen[10:21]]


def test_foreign_cursors_are_refused():
    own = A.token("feed", {"limit": 10}, [1, 2])
    assert A.resumed(own, "feed", {"limit": 10}, 2) == [1, 2]
    for route, asked, keys in (("briefs", {"limit": 10}, 2), ("feed", {"limit": 20}, 2), ("feed", {"limit": 10}, 3)):
        with pytest.raises(ValueError):
            A.resumed(own, route, asked, keys)
    for text in ("", "x", "e30=", A.cursor({"route": "feed"}), own[:-6], "é"):
        with pytest.raises(ValueError):
            A.resumed(text, "feed", {"limit": 10}, 2)
    with pytest.raises(ValueError):
        A.page_after(None, [], 0)
