"""The rule language against a row interpreter of our own, the ladder, and what is refused."""

import ast
import math
import operator
import random

import pytest
from pyspark.sql import functions as F

from sharpsieve.config import DEFAULT_RULES, Config, Rule, default_toml, discover, from_dict, load
from sharpsieve.errors import ConfigError, RuleError
from sharpsieve.functions.rules import compile_value, condition, frame_names, ladder, report_names, validate
from sharpsieve.schema import FLAT

ROWS = [
    (a, b, s, flag, n)
    for a in (None, 0.0, -2.5, 7.0, 12.25)
    for b in (None, 0.0, 3.0, -4.0)
    for s, flag, n in ((None, None, None), ("high", True, 2), ("", False, 0), ("low light", True, -3))
]
DDL = "a double, b double, s string, flag boolean, n int"


def value(node, row):
    """Python's own meaning with missing values, one row at a time."""
    match node:
        case ast.Constant():
            return node.value
        case ast.Name():
            return row[node.id]
        case ast.List() | ast.Tuple():
            return [value(x, row) for x in node.elts]
        case ast.UnaryOp():
            inner = value(node.operand, row)
            if isinstance(node.op, ast.Not):
                return not inner
            return None if inner is None else -inner if isinstance(node.op, ast.USub) else +inner
        case ast.BoolOp():
            test = all if isinstance(node.op, ast.And) else any
            return test(bool(value(x, row)) for x in node.values)
        case ast.IfExp():
            return value(node.body if value(node.test, row) else node.orelse, row)
        case ast.BinOp():
            x, y = value(node.left, row), value(node.right, row)
            if x is None or y is None or (y == 0 and isinstance(node.op, (ast.Div, ast.Mod))):
                return None
            if isinstance(node.op, ast.Pow):
                try:
                    out = x**y
                except (ZeroDivisionError, OverflowError):
                    return None
                return None if isinstance(out, complex) else out
            return {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod}[type(node.op)](x, y)
        case ast.Call():
            args = [value(x, row) for x in node.args]
            flat = args[0] if len(args) == 1 and isinstance(args[0], list) and node.func.id != "len" else args
            return None if any(x is None for x in flat) else {"abs": abs, "min": min, "max": max, "round": round, "len": len}[node.func.id](*args)
        case ast.Compare():
            left = value(node.left, row)
            for op, right in zip(node.ops, node.comparators, strict=True):
                right = value(right, row)
                if isinstance(op, (ast.Eq, ast.Is)):
                    good = left == right
                elif isinstance(op, (ast.NotEq, ast.IsNot)):
                    good = left != right
                elif isinstance(op, (ast.In, ast.NotIn)):
                    good = right is not None and ((left in right) == isinstance(op, ast.In))
                else:
                    good = left is not None and right is not None and {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}[type(op)](left, right)
                if not good:
                    return False
                left = right
            return True
    raise AssertionError(ast.dump(node))


EXPRESSIONS = [
    "a > 3", "not a > 3", "not (a > 3 or b < 1)", "a == b", "a != b", "a == None", "a is None", "a is not None", "s == 'high'", "s != 'high'", "s in ['high', 'low']", "s not in ['high', None]",
    "a in [0, 7, None]", "'igh' in s", "'igh' not in s", "0 <= a < 10", "a < b < n", "1 < 2 < a", "a + b * n", "a / b", "a % b", "a % -3", "a % 0.1", "-a % 0.3", "b % -0.7", "1.0 % 0.1 + a", "1e300 % 3.0 + a", "-7 % 1e300 - a", "a ** 2", "b ** -1", "a ** 0.5", "-a", "+n", "abs(a) + 1", "min(a, b)",
    "max([a, b, n])", "round(a)", "round(b / 2)", "len(s)", "len([1, 2, 3])", "a if flag else b", "a if s else 1", "flag", "not flag", "flag and a", "a or s", "flag == True", "flag is True", "n if n else 'x' == s", "flag + n",
    "s + '!' == 'high!'", "a == 'x'", "None == None", "None < 1", "a < None", "n == 2 and flag or b == 3.0", "s", "''", "0", "[]", "[a]", "(a, b) == (b, a)", "True", "max(flag, n) > 0",
]


def same(x, y):
    if isinstance(x, float) or isinstance(y, float):
        return (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12))
    return x == y


def check(spark, sources):
    df = spark.createDataFrame(ROWS, DDL)
    names = frame_names(df)
    out = df.select(*df.columns, *[condition(e, names).alias(f"t{k}") for k, e in enumerate(sources)], *[v.column.alias(f"v{k}") for k, e in enumerate(sources) if (v := compile_value(e, names)).column is not None])
    for row in out.collect():
        env = {c: row[c] for c in df.columns}
        for k, e in enumerate(sources):
            want = value(ast.parse(e, mode="eval").body, env)
            assert row[f"t{k}"] is bool(want), (e, env, row[f"t{k}"], want)
            if f"v{k}" in row.asDict() and not isinstance(want, list):
                assert same(row[f"v{k}"], want), (e, env, row[f"v{k}"], want)


def test_every_construct(spark):
    check(spark, [e for e in EXPRESSIONS if e != "n if n else 'x' == s"])


def test_random_conditions(spark):
    rng = random.Random(1)

    def number(d):
        if d == 0:
            return rng.choice(["a", "b", "n", "2", "0", "-3.5"])
        x, y = number(d - 1), number(d - 1)
        return rng.choice([f"({x} {rng.choice('+-*/%')} {y})", f"(-{x})", f"abs({x})", f"max({x}, {y})", f"({x} if {truth(d - 1)} else {y})"])

    def truth(d):
        if d == 0:
            return rng.choice(["flag", "s == 'high'", "a > b", "n is None", "'low' in s", "b not in [0, 3]"])
        x, y = truth(d - 1), truth(d - 1)
        return rng.choice([f"not {x}", f"({x} and {y})", f"({x} or {y})", f"({number(d - 1)} {rng.choice(['<', '<=', '>', '>=', '==', '!='])} {number(d - 1)})"])

    check(spark, [truth(2) for _ in range(60)])


@pytest.mark.parametrize(
    "source",
    ["a.b", "a[0]", "lambda: 1", "[x for x in a]", "a // 2", "a & 1", "f'{a}'", "{1: 2}", "max(*a)", "round(a, ndigits=1)", "open('x')", "abs", "'a' < 5", "s * 2", "s < 3", "1 in s", "a in 3", "a is 3", "a >", "x := 3", "nope", "len(a)", "min(a)", "a if flag else s"],
)
def test_refused(spark, source):
    with pytest.raises(RuleError):
        condition(source, frame_names(spark.createDataFrame(ROWS, DDL)))


def test_a_typo_is_told(spark):
    with pytest.raises(RuleError, match="did you mean 'sharp_fraction'"):
        validate([Rule("sharp_fractoin > 1")], "subject_or_max_acutance")
    validate(DEFAULT_RULES, "subject_or_max_acutance")
    assert len(FLAT) == 39 and set(report_names()) == set(FLAT)


def plain_ladder(rules, row, label=None):
    flagged, reasons = label, []
    for rule in rules:
        if not value(ast.parse(rule.when, mode="eval").body, row):
            continue
        reasons.append(rule.reason or rule.when)
        if rule.stars is None:
            flagged = rule.label or flagged
        else:
            return rule.stars, rule.label or flagged, reasons
    return None, flagged, reasons


def test_ladders_against_a_row_interpreter(spark):
    rng = random.Random(4)
    df = spark.createDataFrame(ROWS, DDL)
    for _ in range(12):
        rules = [Rule(rng.choice(["a > 3", "not b > 0", "flag", "s == 'high'", "n is None", "True", "b == 0"]), rng.choice([None, 0, 1, 3, 5]), rng.choice([None, "red", "green", "blue"]), rng.choice(["", "because"])) for _ in range(rng.randint(0, 6))]
        stars, label, reasons = ladder(rules, frame_names(df))
        for row in df.select("*", stars.alias("_r"), label.alias("_l"), reasons.alias("_w")).collect():
            assert (row._r, row._l, row._w) == plain_ladder(rules, row.asDict()), rules


# --- settings


def test_settings_are_checked(tmp_path):
    path = tmp_path / "sharpsieve.toml"
    path.write_text(default_toml())
    assert vars(load(path).rating) == vars(Config().rating) and all(vars(load(path).sections[s]) == vars(Config().sections[s]) for s in Config().sections)
    (tmp_path / "a/b").mkdir(parents=True)
    assert discover(tmp_path / "a/b").source == str(path)
    assert from_dict({"rating": {"rules": []}}).rating.rules == DEFAULT_RULES
    assert from_dict({"input": {"include_suffixes": "JPG"}}).input.include_suffixes == (".jpg",)
    for bad in (
        {"nope": {}}, {"input": {"edge": 1}}, {"input": {"working_edge": 0}}, {"input": {"working_edge": True}}, {"exposure": {"percentile": 50}}, {"subject": {"detectors": []}}, {"subject": {"detectors": ["x"]}},
        {"subject": {"zone": "x"}}, {"subject": {"face_score": 2}}, {"grouping": {"max_distance": -1}}, {"rating": {"rules": [{"stars": 1}]}}, {"rating": {"rules": [{"when": "1", "stars": 6}]}}, {"rating": {"rules": [{"when": "1", "x": 6}]}},
        {"output": {"formats": ["pdf"]}}, {"input": 3},
    ):
        with pytest.raises(ConfigError):
            from_dict(bad)
    path.write_text("not = [toml")
    with pytest.raises(ConfigError):
        load(path)


def test_conditions_never_give_null(spark):
    df = spark.createDataFrame(ROWS, DDL)
    out = df.select(*[condition(e, frame_names(df)).alias(f"c{k}") for k, e in enumerate(["a > b", "s in ['x']", "not a", "a % b == 0", "flag"])])
    assert out.where(" or ".join(f"c{k} is null" for k in range(5))).count() == 0
    assert df.where(condition("a != a", frame_names(df))).count() == 0
    nan = spark.createDataFrame([(float("nan"),)], "a double")
    assert nan.select(condition("a > 1 or a == a or a < 1", frame_names(nan)).alias("c")).first().c is False
    assert F is not None
