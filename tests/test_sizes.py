"""Sizes as texts: equal to Python's formatting, ties at half a tenth too."""

from papyrine.functions import text as tx

QUARTER = 1 << 18


def test_size_text_ties(spark):
    sizes = [1, QUARTER, 3 * QUARTER, 5 * QUARTER, 13 * QUARTER, 13 * QUARTER - 1, 13 * QUARTER + 1, 15 * QUARTER, 4 * QUARTER - 1, (1 << 40) + QUARTER, (1 << 62) + 1, 52428, 52429, 0, None]
    got = {r.n: r.t for r in spark.createDataFrame([(n,) for n in sizes], "n long").select("n", tx.size_text(tx.F.col("n")).alias("t")).collect()}
    assert got == {n: f"{n / 1048576:.1f} MB" if n else "?" for n in sizes}
    assert got[13 * QUARTER] == "3.2 MB" and got[15 * QUARTER] == "3.8 MB"
