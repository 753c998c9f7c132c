
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.dates import to_ymd
from quern.functions.numbers import is_whole, to_cents, to_number, to_price
from quern.functions.text import joined_flags, letters_for_digits, looked_up, tidy, title_case, truthy
from quern.sources.settings import LEET


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_tidy(spark):
    assert apply(spark, tidy, ["  A \t B ", "", "   ", None, "x\n\ny"]) == ["a b", None, None, None, "x y"]


def test_title_case_capitalises_after_any_non_letter(spark):
    values = ["b0tella", "o'neil", "10l bottle", "madríd", "", None]
    assert apply(spark, title_case, values) == ["B0Tella", "O'Neil", "10L Bottle", "Madríd", "", None]


def brute_letters(text, table):
    out = []
    for token in text.lower().split(" "):
        if token and not token[0].isdigit() and not token[-1].isdigit():
            done = ""
            for i, ch in enumerate(token):
                near = (done[-1:].isalpha()) or token[i + 1 : i + 2].isalpha()
                done += table.get(ch, ch) if near else ch
            token = done
        out.append(token)
    return " ".join(out)


def test_letters_for_digits(spark):
    values = ["B0tella", "f00tw3ar", "a00-b", "Trail Shoes 3.0", "Pack 10L", "usb3", "x-00-y", "b.0.c", "two  spaces", "", None]
    assert apply(spark, lambda c: letters_for_digits(c, LEET), values) == [None if v is None else brute_letters(v, LEET) for v in values]
    assert apply(spark, lambda c: letters_for_digits(c, {}), ["B0T"]) == ["b0t"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab01357.- Z", max_size=12), min_size=30, max_size=60))
def test_letters_for_digits_like_a_loop(spark, values):
    assert apply(spark, lambda c: letters_for_digits(c, LEET), values) == [brute_letters(v, LEET) for v in values]


@pytest.mark.parametrize(("text", "value"), [("1", 1.0), (" 2.5 ", 2.5), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("1d", None), ("nan", None), ("1 2", None), ("", None), (None, None), ("one", None), ("-3", -3.0)])
def test_numbers(spark, text, value):
    assert apply(spark, to_number, [text]) == [value]


def test_whole_numbers(spark):
    assert apply(spark, lambda c: is_whole(to_number(c)), ["3", "3.0", "2.5", "inf", None]) == [True, True, False, False, False]


def test_prices(spark):
    assert apply(spark, to_price, ["$15,50", "15.5 €", "-5", "free", "1.234,50", None, ""]) == [15.5, 15.5, -5.0, None, None, None, None]


def test_cents_round_in_binary(spark):
    assert spark.range(1).select(to_cents(F.lit(1.005)), to_cents(F.lit(0.285)), to_cents(F.lit(2.5))).first() == (1.0, 0.28, 2.5)


def test_dates_are_judged_alone(spark):
    values = ["2025-1-5", "2025/01/05", "2025-01-05 00:00:00", "25-01-05", "2025-02-30", "05-01-2025", " 2025-03-01 ", "A_A_A", "", None]
    found = [str(d) if d else None for d in apply(spark, to_ymd, values)]
    assert found == ["2025-01-05", "2025-01-05", None, None, None, None, "2025-03-01", None, None, None]


def test_flags_and_lookup(spark):
    row = spark.range(1).select(joined_flags([("a", F.lit(True)), ("b", F.lit(None).cast("boolean")), ("c", F.lit(True))]), joined_flags([("a", F.lit(False))]),
                                looked_up(F.lit("x"), {"x": "y"}), looked_up(F.lit("z"), {"x": "y"}), looked_up(F.lit(None).cast("string"), {"x": "y"})).first()
    assert tuple(row) == ("a|c", None, "y", "z", None)
    assert apply(spark, truthy, ["Yes", "1", "t", "no", None]) == [1, 1, 1, 0, 0]


def test_trimming_knows_every_white_space(spark):
    from quern.functions.text import SPACES, trimmed

    cells = [None, "", " ", "a", "a\n", "\na", " a b ", "é", "\u3000é\x1c", *[f"{s}x{s}" for s in SPACES], "x" * 50 + "\r\n", "~!"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", trimmed(F.col("c")).alias("t")).collect()
    assert [r["t"] for r in sorted(rows)] == [None if c is None else c.strip() for c in cells]
