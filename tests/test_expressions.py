"""The expression parser: what each operator means and how tightly it binds."""

import math

import pytest

from hyperlake.functions import expressions as ex

ROW = {"a": 7, "b": 2, "x": -7.5, "s": "it's", "n": None, "xs": [3, 1, 2], "t": True}
CASES = [
    ("a >= 7", True), ("a <= 6", False), ("a <> b", True), ("a != 7", False), ("a == 7", True), ("n <=> null", True), ("n = 1", None), ("a > b", True), ("1 < b <= 2 < a", True), ("1 < b < 2", False),
    ("a // b", 3), ("x // b", -4), ("-a // b", -4), ("(a + 1) // (b + 1) * b", 4), ("a // b // 2", 1), ("a * a // b", 24), ("floor(a / b) // 2", 1), ("(a // b) ** b", 9.0),
    ("2 ** 3 ** 2", 512.0), ("-2 ** 2", -4.0), ("2 ** -1", 0.5), ("(a + b) ** 2", 81.0), ("abs(x) ** 2", 56.25), ("a % 4", 3), ("a div b", 3), ("a / b", 3.5), ("a + b * 2", 11), ("(a + b) * 2", 18), ("a - b - 1", 4), ("a - -b", 9),
    ("cast(x as int)", -7), ("cast(a as decimal(10, 2)) > 1", True), ("cast('3' as bigint) + 1", 4), ("int(x)", -7), ("bool(a)", True), ("float(a) / 2", 3.5), ("round(2.5)", 2), ("len(xs)", 3), ("sum(xs)", 6.0),
    ("min(a, b)", 2), ("max(xs)", 3), ("min(xs)", 1), ("clip(a, 1, 5)", 5), ("softplus(50)", 50.0), ("isfinite(x)", True), ("log(exp(1))", 1.0),
    ("not a > 3 and b > 1", False), ("not (a > 3 and b > 5)", True), ("a > 9 or b = 2 and a = 7", True), ("(a > 9 or b = 2) and a = 8", False), ("t and not n is null", False), ("n is not null", False), ("t is true", True), ("n is None", True),
    ("a in (1, 7)", True), ("a not in (1, 2)", True), ("a in [1, 2]", False), ("b in xs", True), ("a between 1 and 7 and b between 2 and 3", True), ("a not between 1 and 6", True), ("s = 'it''s'", True), ("s = 'it\\'s'", True), ("s || '!'", "it's!"),
    ("case when a > 9 then 1 when a >= 7 then 2 else 3 end", 2), ("case a when 7 then 'seven' end", "seven"), ("case when a > 9 then 1 end", None), ("1 if a > 9 else 2 if b > 1 else 3", 2), ("xs[0] + xs[b]", 5), ("a & 3 | 8", 11), ("a ^ 1", 6), ("~b", -3),
    ("A_B.c = 1", True), ("1e2 + .5 + 2d", 102.5), ("coalesce(n, 4)", 4), ("True", True),
]


@pytest.fixture(scope="module")
def frame(spark):
    kind = "a int, b int, x double, s string, n int, xs array<int>, t boolean, A_B struct<c: int>"
    return spark.createDataFrame([(*ROW.values(), (1,))], kind)


def test_values(frame):
    got = frame.select(*[ex.checked(text, frame.columns).alias(f"c{i}") for i, (text, _) in enumerate(CASES)]).first()
    for i, (text, wanted) in enumerate(CASES):
        assert got[i] == wanted or isinstance(wanted, float) and math.isclose(got[i], wanted), (text, got[i])


@pytest.mark.parametrize("text", ["a; b", "a b", "(a", "a)", "a +", "exec(a)", "cast(a int)", "case a end", "a in (1", "zzz + 1", "a ? b", "a > > b", "in", "'open", "a.b(1)", "clip(a)"])
def test_refused(frame, text):
    with pytest.raises(ValueError):
        ex.checked(text, frame.columns)


def test_names():
    assert ex.names_in("l__qty >= p_low and cast(v_o as int) // 2 <> b_q or A_B.c in (x, 'y') and (case when `odd name` then min(u, w) end) is null") == {"l__qty", "p_low", "v_o", "b_q", "A_B.c", "x", "odd name", "u", "w"}
