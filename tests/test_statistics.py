"""Statistics of checkouts that may not be there."""

from cairn.operators import stats
from tests.test_catalog import revs


def test_checkouts_without_version_control(spark):
    r = revs(spark, [("/a", "DEVELOP", "kim", "20240101", 86400.0), ("/b", "DEVELOP", "amy", "20240101", 0.0), ("/b", "ARCHIVE", "amy", "20240101", 0.0)])
    assert stats.checkout_statistics({}) is None
    found = {n: t.collect() for n, t in stats.checkout_statistics({"revisions": r}).items()}
    assert [tuple(x) for x in found["users"]] == [("amy", 1), ("kim", 1)] and [tuple(x) for x in found["by_day"]] == [("20240101", 2)]
    assert [tuple(x) for x in found["by_os"]] == [("LINUX", 2)] and sum(x["count"] for x in found["staleness"]) == 2
    none = {n: t.collect() for n, t in stats.checkout_statistics({"revisions": r}, configured=False).items()}
    assert none["users"] == none["by_os"] == none["by_day"] == [] and sum(x["count"] for x in none["staleness"]) == 0
