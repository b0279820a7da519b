"""Rule texts of six cities, grouped events and markets without books."""

import json

from pyspark.sql import functions as F

from skyledger.operators import rules as R
from skyledger.operators import trade as T
from skyledger.sources import payloads as P

STATIONS = [
    (0, "Seoul", [], "South Korea", "Asia/Seoul", "RKSI", "Incheon Intl Airport", 37.4, 126.4, "Aviation Meteorological Office AIR_CALP", "RKSI"),
    (1, "NYC", ["new york"], "United States", "America/New_York", "KLGA", "LaGuardia Airport", 40.7, -73.8, "Wunderground Public Historical API", "KLGA"),
    (2, "London", [], "United Kingdom", "Europe/London", "EGLC", "London City Airport", 51.5, 0.0, "Wunderground Public Historical API", "EGLC"),
    (3, "Hong Kong", [], "Hong Kong", "Asia/Hong_Kong", "HKA", "Hong Kong International Airport", 22.3, 113.9, None, None),
    (4, "Taipei", [], "Taiwan", "Asia/Taipei", "466920", "Taipei Station", 25.0, 121.5, None, None),
    (5, "Toronto", [], "Canada", "America/Toronto", "CYYZ", "Toronto Pearson Intl Airport", 43.6, -79.6, "Wunderground Public Historical API", "CYYZ"),
    (6, "Tel Aviv", [], "Israel", "Asia/Jerusalem", "LLBG", "Ben Gurion International Airport", 32.0, 34.8, None, "LLBG"),
    (7, "Seoul", [], "South Korea", "Asia/Seoul", "RKSS", "Gimpo", 37.5, 126.8, None, None),
]
COLUMNS = "ordinal int, city string, aliases array<string>, country string, timezone string, station_id string, station_name string, lat double, lon double, public_truth_source_name string, public_truth_station_id string"
FINAL = ' This market can not resolve to "Yes" until all data for this date has been finalized. It measures temperatures to whole degrees Celsius. Any revisions made after data is finalized for this day will not be considered.'
WU = "recorded at the {} Station in degrees Celsius on {}. Source: Wunderground, https://www.wunderground.com/history/daily/{}."


def specs(spark, rows):
    df = spark.createDataFrame(rows, "id int, text string, question string, outcomes array<string>, zone string")
    out = R.market_specs(df, "text", spark.createDataFrame(STATIONS, COLUMNS), "question", "outcomes", "zone")
    return {r["id"]: r["spec"].asDict() for r in out.collect()}


def asked(city, day="March 18"):
    return f"Highest temperature in {city} on {day}?"


def test_the_six_city_cases_and_noaa(spark):
    labels, c = ["20°C or below", "21°C", "22°C or higher"], "Celsius"
    rows = [
        (0, "x " + WU.format("Incheon Intl Airport", "11 Dec '25", "kr/incheon/RKSI") + FINAL, asked("Seoul", "December 11"), labels, None),
        (1, "x " + WU.format("LaGuardia Airport", "20 Dec '25", "us/ny/new-york-city/KLGA") + FINAL, asked("New York"), ["34°F or below", "35–36°F", "37°F or higher"], None),
        (2, "x " + WU.format("London City Airport", "18 Mar '26", "gb/london/EGLC") + FINAL, asked("london"), labels, "UTC"),
        (3, f"x recorded at the Hong Kong International Airport Station in degrees {c} on 13 Mar '25. Hong Kong Observatory https://data/opendata.php?station=HKA&lang=en.", asked("Hong Kong"), labels, None),
        (4, "x on 13 Mar '25. Central Weather Administration, Taipei station 466920, official pages.", asked("Taipei"), labels, None),
        (5, "x " + WU.format("Toronto Pearson Intl Airport", "21 Mar '26", "ca/mississauga/CYYZ") + FINAL, asked("Toronto"), labels, None),
        (6, "recorded by NOAA at the Ben Gurion International Airport in degrees Celsius on 23 Mar '26, information from NOAA https://www.weather.gov/wrh/timeseries?site=LLBG ok", asked("Tel Aviv"), labels, None),
    ]
    got = specs(spark, rows)
    facts = ("city", "station_name", "station_id", "timezone", "truth_track", "public_truth_source_name", "public_truth_station_id")
    assert {i: tuple(s[f] for f in facts) for i, s in got.items()} == {
        0: ("Seoul", "Incheon Intl Airport", "RKSI", "Asia/Seoul", "research_public", "Aviation Meteorological Office AIR_CALP", "RKSI"),
        1: ("NYC", "LaGuardia Airport", "KLGA", "America/New_York", "research_public", "Wunderground Public Historical API", "KLGA"),
        2: ("London", "London City Airport", "EGLC", "Europe/London", "research_public", "Wunderground Public Historical API", "EGLC"),
        3: ("Hong Kong", "Hong Kong International Airport", "HKA", "Asia/Hong_Kong", "exact_public", "Hong Kong Observatory Daily Extract", "HKA"),
        4: ("Taipei", "Taipei Station", "466920", "Asia/Taipei", "exact_public", "Central Weather Administration", "466920"),
        5: ("Toronto", "Toronto Pearson Intl Airport", "CYYZ", "America/Toronto", "research_public", "Wunderground Public Historical API", "CYYZ"),
        6: ("Tel Aviv", "Ben Gurion International Airport", "LLBG", "Asia/Jerusalem", "exact_public", "NOAA Timeseries", "LLBG"),
    }
    assert all(s["error"] is None for s in got.values())
    assert [str(got[i]["target_date"]) for i in range(7)] == ["2025-12-11", "2025-12-20", "2026-03-18", "2025-03-13", "2025-03-13", "2026-03-21", "2026-03-23"]
    assert (got[0]["wait_for_finalized"], got[0]["ignore_late_revision"], got[0]["lat"]) == (True, True, 37.4)
    assert [(got[i]["unit"], got[i]["step"], got[i]["rounding"]) for i in (0, 1)] == [("C", 1.0, "whole_degree"), ("F", 2.0, "range_bin")]


def test_negative_labels_are_no_range_and_lines_stand_in_for_labels(spark):
    text = WU.format("Incheon Intl Airport", "5 Jan '26", "kr/incheon/RKSI")
    rows = [
        (0, text, asked("Seoul"), ["-1°C or below", "0°C", "2°C or higher"], None),
        (1, f"{asked('Seoul')}\n{text}\n 20°C or below \n21-22°C\n", None, None, None),
        (2, f"<html><script>1°</script><body><p>{asked('Seoul')}</p>{text}<li>20&deg;C</li></body></html>", "", [], None),
    ]
    got = specs(spark, rows)
    assert [got[i]["rounding"] for i in range(3)] == ["whole_degree", "range_bin", "whole_degree"]
    assert got[1]["outcomes"] == ["20°C or below", "21-22°C"] and got[2]["outcomes"] == ["20°C"] and got[2]["station_id"] == "RKSI"


def test_station_ladder_and_errors(spark):
    date, labels = " on 5 Jan '26 ", ["1°C"]
    rows = [
        (0, date + "Wunderground", asked("Seoul"), labels, None),  # the city's first station
        (1, date + "Wunderground https://x/RKSS/", asked("Seoul"), labels, None),  # a station of its own
        (2, date + "recorded at the Old Mill Station. Wunderground https://x/ZZZZ/", asked("Atlantis"), labels, None),
        (3, date + "nothing known", asked("Seoul"), labels, None),
        (4, date + "the CWA", asked("Atlantis"), labels, "Asia/Tokyo"),
        (5, None, None, labels, None),
        (6, "no date, CWA", "What is it?", labels, None),
        (7, date + "Hong Kong Observatory", asked("Seoul"), [], None),
        (8, date + "by the CWA at station 12345", asked("Atlantis"), labels, "Asia/Tokyo"),
    ]
    got = specs(spark, rows)
    assert [got[i]["error"] for i in range(9)] == [None, None, "unknown_station", "unsupported_source", "missing_station_name", "missing_question", "unsupported_question", "missing_outcomes", None]
    assert (got[0]["station_id"], got[1]["station_name"], got[1]["city"]) == ("RKSI", "Gimpo", "Seoul")
    assert (got[8]["station_id"], got[8]["station_name"], got[8]["timezone"], got[8]["city"]) == ("12345", "12345", "Asia/Tokyo", "Atlantis")


def test_grouped_events_with_text_prices_and_fallbacks(spark):
    part = {"question": "Will it be 21°C on May 1?", "outcomePrices": '["0.3", "0.7"]', "clobTokenIds": ["t1", "t2"], "questionID": "q1", "conditionId": "c1"}
    events = {
        "text": {"title": " T ", "slug": " s ", "description": " rules ", "markets": [part]},
        "list": {"id": 7, "questionID": "eq", "markets": [part | {"outcomePrices": [0.4, 0.6], "description": "own", "resolutionSource": "url"}], "description": "event"},
        "bad price": {"markets": [part | {"outcomePrices": "0.3"}], "description": "d"},
        "text tokens": {"markets": [part | {"clobTokenIds": '["t1"]'}], "description": "d"},
        "no rules": {"markets": [part], "description": " "},
        "none": {"markets": []},
        "bare": {"markets": [{k: v for k, v in part.items() if not k.endswith("ID") and k != "conditionId"}], "description": "d"},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in events.items()] + [("broken", "{")], "k string, p string")
    got = {r["k"]: r["g"].asDict() for r in df.select("k", P.grouped_event(F.col("p"), F.lit("http://page")).alias("g")).collect()}
    assert {k: g["error"] for k, g in got.items()} == {
        "text": None, "list": None, "bad price": "malformed_component_market", "text tokens": "malformed_component_market",
        "no rules": "missing_description", "none": "missing_component_markets", "broken": "missing_component_markets", "bare": None,
    }
    assert [tuple(o) for o in got["text"]["outcomes"]] == [("21°C", "0.3", "t1")] and got["list"]["outcomes"][0]["price"] == "0.4"
    assert [(got[k]["id"], got[k]["condition_id"], got[k]["description"]) for k in ("text", "list", "bare")] == [(" s ", "q1", "rules"), ("7", "eq", "own"), ("http://page", "http://page", "d")]
    assert (got["text"]["question"], got["text"]["slug"], got["list"]["resolution_source"]) == ("T", "s", "url")


def test_markets_without_books_keep_a_row(spark):
    level = "array<struct<price:double,size:double>>"
    books = spark.createDataFrame([("a", "x", 0, 0.9, "clob", [(0.4, 9.0)], [(0.5, 9.0)]), ("b", "x", 0, 0.9, "missing", [], [])], f"m string, outcome_label string, o int, fair_probability double, source string, bids {level}, asks {level}")
    markets = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "m string")
    out = T.signal_reasons(books, ["m"], ["o"], 0.1, 5000, 1.0, markets=markets)
    assert {r["m"]: (r["book_count"], r["reason"]) for r in out.collect()} == {"a": (1, "tradable"), "b": (1, "missing_book"), "c": (0, "missing_token_mapping"), None: (0, "missing_token_mapping")}
