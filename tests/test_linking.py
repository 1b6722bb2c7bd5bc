"""Pairs across statements: against a plain search over all free rows."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F
from tarazu.operators import linking


def plain(outs, ins, window, across):
    free, found = list(range(len(ins))), []
    for j, (name, _, day) in enumerate(outs):
        near = [(abs(ins[k][2] - day), k) for k in free if window[0] <= ins[k][2] - day <= window[1] and not (across and ins[k][0] == name)]
        if near:
            found.append((j, min(near)[1]))
            free.remove(min(near)[1])
    return found


def test_matches_are_the_nearest_free_ones():
    own = random.Random(6)
    for n in range(200):
        rows = lambda: [(own.choice("abc"), k, own.randrange(own.choice([3, 40]))) for k in range(own.randrange(30))]  # noqa: E731, B023
        outs, ins, window, across = rows(), rows(), own.choice([(0, 3), (-2, 7), (0, 0)]), n % 2 == 0
        assert linking.matched(outs, ins, window, across) == plain(outs, ins, window, across)


def test_one_amount_on_every_day_is_matched_in_time():
    outs = [("a", k, k // 50) for k in range(60_000)]
    ins = [("b", k, k // 50) for k in range(60_000)]
    assert len(linking.matched(outs, ins, (0, 3), True)) == 60_000


def test_pairs_of_a_table(spark):
    own = random.Random(9)
    rows = [(own.choice("abc"), k, date(2024, 1, 1) + timedelta(own.randrange(90)), own.choice([100, 100, 100, 250, 7]), own.random() < 0.5) for k in range(400)]
    table = spark.createDataFrame(rows, "statement_id string, seq long, date date, amount long, out boolean").withColumn("place", F.struct(F.col("seq").alias("a"))).repartition(5)
    got = linking.pair_off(table.filter("out").drop("out"), table.filter("not out").drop("out"), (0, 3), True)
    expected = []
    for amount in (100, 250, 7):
        sides = [[(r[0], r[1], r[2].toordinal()) for r in rows if r[3] == amount and r[4] == side] for side in (True, False)]
        expected += [(sides[0][j][0], sides[0][j][1], sides[1][k][0], sides[1][k][1], amount, sides[1][k][2] - sides[0][j][2]) for j, k in plain(*sides, (0, 3), True)]
    assert sorted(map(tuple, got.collect())) == sorted(expected) and len(expected) > 50
    assert linking.pair_off(table.filter("false").drop("out"), table.filter("not out").drop("out"), (0, 3), True).count() == 0
