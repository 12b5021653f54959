"""What the address bar offers."""

import pytest

from geotrail.operators.search import search, search_dates, search_text


@pytest.fixture(scope="module")
def days(spark):
    return spark.createDataFrame([(d,) for d in ("2021-11-03", "2021-11-30", "2022-04-09", "2023-04-09", None)], "date_str string")


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("2021/11/3", ["2021-11-03"]),
        ("2021年11月30日", ["2021-11-30"]),
        ("２０２２．４．９", ["2022-04-09"]),
        ("2022 - 4", ["2022-04"]),
        ("2023年", ["2023"]),
        ("4月9日", ["2022-04-09", "2023-04-09"]),
        ("4-9", ["2022-04-09", "2023-04-09"]),
        ("4.9", []),
        ("2022-00", []),
        ("2022-13", []),
        ("2020", []),
        ("2021-11-03x", []),
        ("a2021", []),
        ("2021年11日", []),
        ("2021--11", []),
        ("12345", []),
        ("", []),
    ],
)
def test_dates_that_a_query_spells(spark, days, query, want):
    got = search_dates(spark.createDataFrame([(query,)], "query string"), days)
    assert sorted(r["label"] for r in got.collect()) == want


def test_names_in_any_width_and_of_any_variant(spark):
    rows = [("municipality", "Region 1-2", ["Bezirk Eins"], False), ("municipality", "Old Region 1", [], True), ("prefecture", "Region 1", ["Ｒ１"], True), ("prefecture", "Region 1", None, True), ("day", "2021-11-03", [], False)]
    c = spark.createDataFrame(rows, "kind string, label string, names array<string>, unvisited boolean")
    labels = lambda q: [(r["kind"], r["label"], r["score"]) for r in search_text(c.fillna({}), q).collect()]
    assert labels("Ｒｅｇｉｏｎ　１") == [("municipality", "Region 1-2", 0), ("prefecture", "Region 1", 0), ("municipality", "Old Region 1", 1)]
    assert labels("bezirk") == [("municipality", "Region 1-2", 0)] and labels("r1") == [("prefecture", "Region 1", 0)]


def test_dates_first_then_names_each_once_and_nothing_private(spark, days):
    rows = [("day", "2021-11-03", False), ("day", "2021-11-30", False), ("place", "Hut 2021-11-03", False), ("prefecture", "Shore 2021-11-03", True)]
    c = spark.createDataFrame(rows, "kind string, label string, unvisited boolean")
    got = [(r["position"], r["kind"], r["label"], r["score"]) for r in search(c, days, "2021-11-03").collect()]
    assert got == [(1, "day", "2021-11-03", -1), (2, "place", "Hut 2021-11-03", 1), (3, "prefecture", "Shore 2021-11-03", 1)]
    assert [r["label"] for r in search(c, days, "2021-11-03", private=True).collect()] == ["Shore 2021-11-03"]
    assert [r["label"] for r in search(c, days, "2021-11", private=True).collect()] == ["2021-11", "Shore 2021-11-03"]
    assert search(c.limit(0), days.limit(0), "x").count() == 0 and search(c, days, "2021-11-03", limit=2).count() == 2
