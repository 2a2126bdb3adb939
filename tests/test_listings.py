"""Listings read to their end, against the chain told in plain words."""

import random

from tidemark.operators import gates as G


def by_hand(rows):
    def chain(start):
        pages, at = [start], start
        while rows[at][4]:
            step = next((i for i in range(at + 1, len(rows)) if rows[i][1]), None)
            if step is None or rows[step][2] != rows[start][2]:
                return None
            while not rows[step][3]:
                again = next((i for i in range(step + 1, len(rows)) if rows[i][1]), None)
                if again is None or rows[again][1] != rows[step][1] or rows[again][2] != rows[start][2]:
                    return None
                step = again
            pages.append(step)
            at = step
        return pages

    found = (chain(i) for i, r in enumerate(rows) if not r[1] and r[3])
    pages = next((p for p in found if p is not None), None)
    items = None if pages is None or any(rows[i][5] is None for i in pages) else sum(rows[i][5] for i in pages)
    return pages and len(pages), items


def test_listings_of_random_calls(spark):
    r = random.Random(7)
    calls = {k: [(i, r.choice([None, "", "t", "t", "u"]), r.choice(["w", "w", "w", "v", None]), r.random() < 0.7, r.random() < 0.5, r.choice([None, 1, 2, 3, 4])) for i in range(r.randrange(1, 9))] for k in range(400)}
    rows = [(k, *c) for k, cs in calls.items() for c in cs]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, seq int, token string, asked string, ok boolean, more boolean, items int")
    got = G.read_to_end(df, ["k"])
    assert {x.k: (x.pages, x.items) for x in got.collect()} == {k: by_hand(cs) for k, cs in calls.items()}
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()  # no call of Python for each key
