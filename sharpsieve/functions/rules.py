"""The rule language: a subset of Python expressions, compiled to null-safe columns.

Two-valued: an ordered comparison with a missing value is false, so its negation is
true; arithmetic with a missing value is missing; `and`, `or` and `not` give true or
false. Kinds of values are checked when a rule is compiled, so a rule that would mix
text and numbers in an ordered comparison or in arithmetic is refused before any row
is read. A power without a real result is missing.
"""

from __future__ import annotations

import ast
import difflib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharpsieve.config import Rule
from sharpsieve.errors import RuleError
from sharpsieve.schema import FLAT, flat_columns

FUNCTIONS = ("abs", "min", "max", "round", "len")


@dataclass
class Value:
    """A column and its kind: number, bool, text, none, or list (of values)."""

    kind: str
    column: Column | None = None
    items: tuple["Value", ...] = ()


def _kind(sql_type: str) -> str:
    return {"string": "text", "boolean": "bool"}.get(sql_type, "number")


def _compatible(a: Value, b: Value) -> bool:
    numeric = ("number", "bool")
    return a.kind == b.kind or (a.kind in numeric and b.kind in numeric)


def _as_number(v: Value) -> Column:
    return v.column.cast("int") if v.kind == "bool" else v.column


def _equal(a: Value, b: Value) -> Column:
    """Python's ==, which knows missing values and never fails."""
    if a.kind == "none" or b.kind == "none":
        other = b if a.kind == "none" else a
        return F.lit(True) if other.kind == "none" else F.lit(False) if other.kind == "list" else other.column.isNull()
    if "list" in (a.kind, b.kind):
        if a.kind != b.kind or len(a.items) != len(b.items):
            return F.lit(False)
        out = F.lit(True)
        for x, y in zip(a.items, b.items, strict=True):
            out = out & _equal(x, y)
        return out
    if not _compatible(a, b):
        return a.column.isNull() & b.column.isNull()
    left, right = (_as_number(a), _as_number(b)) if a.kind != b.kind else (a.column, b.column)
    both = left.eqNullSafe(right)
    return both & ~_nan(a) if a.kind == "number" else both


def _nan(v: Value) -> Column:
    return F.coalesce(F.isnan(v.column.cast("double")), F.lit(False)) if v.kind == "number" else F.lit(False)


def truthy(v: Value) -> Column:
    """Python's truth of a value, never null."""
    if v.kind == "none":
        return F.lit(False)
    if v.kind == "list":
        return F.lit(bool(v.items))
    if v.kind == "bool":
        return F.coalesce(v.column, F.lit(False))
    return F.coalesce(F.length(v.column) > 0 if v.kind == "text" else v.column != 0, F.lit(False))


class Compiler(ast.NodeVisitor):
    def __init__(self, source: str, names: Mapping[str, tuple[str, Column]]):
        self.source, self.names = source, names

    def fail(self, why: str) -> None:
        raise RuleError(f"in '{self.source}': {why}")

    def compile(self) -> Value:
        try:
            tree = ast.parse(self.source, mode="eval")
        except SyntaxError as error:
            raise RuleError(f"can't parse '{self.source}': {error.msg}") from error
        return self.visit(tree.body)

    def generic_visit(self, node: ast.AST) -> Value:
        self.fail(f"{type(node).__name__} isn't allowed")
        raise AssertionError

    def visit_Constant(self, node: ast.Constant) -> Value:
        if node.value is None:
            return Value("none", F.lit(None))
        for kinds, kind in ((bool, "bool"), ((int, float), "number"), (str, "text")):
            if isinstance(node.value, kinds):
                return Value(kind, F.lit(node.value))
        self.fail(f"a constant of type {type(node.value).__name__} isn't allowed")
        raise AssertionError

    def visit_Name(self, node: ast.Name) -> Value:
        if node.id in self.names:
            kind, column = self.names[node.id]
            return Value(kind, column)
        if node.id in FUNCTIONS:
            self.fail(f"'{node.id}' has to be called")
        near = difflib.get_close_matches(node.id, list(self.names), n=1, cutoff=0.6)
        self.fail(f"unknown name '{node.id}'" + (f"; did you mean '{near[0]}'?" if near else ""))
        raise AssertionError

    def _items(self, node: ast.List | ast.Tuple) -> Value:
        return Value("list", None, tuple(self.visit(x) for x in node.elts))

    visit_List = visit_Tuple = _items

    def number(self, v: Value, what: str) -> Value:
        if v.kind not in ("number", "bool", "none"):
            self.fail(f"{what} needs numbers")
        return Value("number", F.lit(None).cast("double") if v.kind == "none" else _as_number(v))

    def visit_UnaryOp(self, node: ast.UnaryOp) -> Value:
        inner = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            return Value("bool", ~truthy(inner))
        if isinstance(node.op, ast.USub):
            return Value("number", -self.number(inner, "a sign").column)
        if isinstance(node.op, ast.UAdd):
            return self.number(inner, "a sign")
        return self.generic_visit(node.op)

    def visit_BoolOp(self, node: ast.BoolOp) -> Value:
        parts = [truthy(self.visit(x)) for x in node.values]
        out = parts[0]
        for x in parts[1:]:
            out = out & x if isinstance(node.op, ast.And) else out | x
        return Value("bool", out)

    def visit_BinOp(self, node: ast.BinOp) -> Value:
        a, b = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, ast.Add) and a.kind == b.kind == "text":
            return Value("text", F.concat(a.column, b.column))
        x, y = self.number(a, "arithmetic").column, self.number(b, "arithmetic").column
        if isinstance(node.op, (ast.Add, ast.Sub, ast.Mult)):
            # as double where it could overflow: rows never fail
            x, y = x.cast("double"), y.cast("double")
            return Value("number", x + y if isinstance(node.op, ast.Add) else x - y if isinstance(node.op, ast.Sub) else x * y)
        x, y = x.cast("double"), y.cast("double")
        if isinstance(node.op, ast.Div):
            return Value("number", F.try_divide(x, y))
        if isinstance(node.op, ast.Mod):
            y = F.when(y != 0, y)
            rest = x % y  # exact, with the sign of x; the rule language takes the sign of y
            return Value("number", F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest))
        if isinstance(node.op, ast.Pow):
            power = F.pow(x, y)
            return Value("number", F.when(~F.isnan(power) & (F.abs(power) != float("inf")), power))
        return self.generic_visit(node.op)

    def visit_Compare(self, node: ast.Compare) -> Value:
        out, left = F.lit(True), self.visit(node.left)
        for op, right in zip(node.ops, map(self.visit, node.comparators), strict=True):
            out = out & self.compared(left, op, right)
            left = right
        return Value("bool", out)

    def compared(self, a: Value, op: ast.cmpop, b: Value) -> Column:
        if isinstance(op, (ast.Eq, ast.NotEq)):
            same = _equal(a, b)
            return same if isinstance(op, ast.Eq) else ~same
        if isinstance(op, (ast.Is, ast.IsNot)):
            if b.kind == "none" or a.kind == "none":
                same = _equal(a, b)
            elif a.kind == b.kind == "bool":
                same = a.column.eqNullSafe(b.column)
            else:
                self.fail("'is' is for None, True and False")
            return same if isinstance(op, ast.Is) else ~same
        if isinstance(op, (ast.In, ast.NotIn)):
            return self.contained(a, b, isinstance(op, ast.In))
        if "none" in (a.kind, b.kind):
            return F.lit(False)
        if "list" in (a.kind, b.kind) or not _compatible(a, b):
            self.fail("an ordered comparison needs two numbers or two texts")
        x, y = (_as_number(a), _as_number(b)) if a.kind != "text" else (a.column, b.column)
        test = x < y if isinstance(op, ast.Lt) else x <= y if isinstance(op, ast.LtE) else x > y if isinstance(op, ast.Gt) else x >= y
        return F.coalesce(test, F.lit(False)) & ~_nan(a) & ~_nan(b)

    def contained(self, a: Value, b: Value, wanted: bool) -> Column:
        if b.kind == "none":
            return F.lit(False)
        if b.kind == "text":
            if a.kind not in ("text", "none"):
                self.fail("only a text can be in a text")
            if a.kind == "none":
                self.fail("None can't be in a text")
            found = F.coalesce(F.contains(b.column, a.column), F.lit(False))
            return b.column.isNotNull() & (found if wanted else ~found)
        if b.kind != "list":
            self.fail("'in' needs a list or a text")
        found = F.lit(False)
        for x in b.items:
            found = found | _equal(a, x)
        return found if wanted else ~found

    def visit_IfExp(self, node: ast.IfExp) -> Value:
        test, a, b = truthy(self.visit(node.test)), self.visit(node.body), self.visit(node.orelse)
        if "list" in (a.kind, b.kind):
            self.fail("a choice between lists isn't allowed")
        kind = a.kind if a.kind != "none" else b.kind
        if "none" not in (a.kind, b.kind) and a.kind != b.kind:
            if not _compatible(a, b):
                self.fail("both sides of a choice must be of one kind")
            return Value("number", F.when(test, _as_number(a)).otherwise(_as_number(b)))
        return Value(kind, F.when(test, a.column).otherwise(b.column))

    def visit_Call(self, node: ast.Call) -> Value:
        if not isinstance(node.func, ast.Name) or node.func.id not in FUNCTIONS or node.keywords or any(isinstance(x, ast.Starred) for x in node.args):
            self.fail("only abs, min, max, round and len can be called, with plain arguments")
        name, args = node.func.id, [self.visit(x) for x in node.args]
        if name in ("min", "max"):
            items = list(args[0].items) if len(args) == 1 and args[0].kind == "list" else args
            if len(items) < (1 if len(args) == 1 and args[0].kind == "list" else 2):
                self.fail(f"{name} needs two values or a list")
            columns = [x.column for x in items] if all(x.kind == "text" for x in items) else [self.number(x, name).column.cast("double") for x in items]
            known = F.lit(True)
            for c in columns:
                known = known & c.isNotNull()
            picked = (F.least if name == "min" else F.greatest)(*columns) if len(columns) > 1 else columns[0]
            return Value("text" if all(x.kind == "text" for x in items) else "number", F.when(known, picked))
        if name == "len":
            if len(args) != 1 or args[0].kind not in ("text", "list"):
                self.fail("len needs a text or a list")
            return Value("number", F.length(args[0].column) if args[0].kind == "text" else F.lit(len(args[0].items)))
        if name == "abs":
            if len(args) != 1:
                self.fail("abs needs one value")
            return Value("number", F.abs(self.number(args[0], "abs").column))
        digits = 0
        if len(node.args) == 2:
            try:
                digits = ast.literal_eval(node.args[1])
            except ValueError:
                digits = None
        if not 1 <= len(args) <= 2 or not isinstance(digits, int):
            self.fail("round needs a value, and digits as a whole number")
        # whole numbers: half to even, exactly; with digits Spark rounds the shortest decimal of a value, not its exact binary one
        value = self.number(args[0], "round").column.cast("double")
        if digits == 0:
            return Value("number", F.rint(value))
        return Value("number", F.bround(value, digits))


def compile_value(source: str, names: Mapping[str, tuple[str, Column]]) -> Value:
    return Compiler(source, names).compile()


def report_names(**fixed: Column) -> dict[str, tuple[str, Column]]:
    """The names of a report's flat view; fixed replaces some of the columns."""
    columns = flat_columns() | fixed
    return {k: (_kind(FLAT[k]), columns[k]) for k in FLAT}


def frame_names(df: DataFrame) -> dict[str, tuple[str, Column]]:
    """The plain columns of any table as names."""
    return {k: (_kind(t), F.col(f"`{k}`")) for k, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary", "timestamp", "date"))}


def condition(source: str, names: Mapping[str, tuple[str, Column]]) -> Column:
    """The truth of an expression, never null."""
    return truthy(compile_value(source, names))


def validate(rules: Iterable[Rule], rank_by: str, names: Mapping[str, tuple[str, Column]] | None = None) -> None:
    """Compile all, keep nothing: errors show before any row is read."""
    names = names or report_names()
    for rule in rules:
        condition(rule.when, names)
    compile_value(rank_by, names)


def ladder(rules: Iterable[Rule], names: Mapping[str, tuple[str, Column]], *, base: Column | None = None, rating: Column | None = None, label: Column | None = None) -> tuple[Column, Column, Column]:
    """(rating, label, reasons): the first rule with stars decides; rules without stars before it add a label and a reason.

    base, rating and label are what a row has before.
    """
    base = F.expr("cast(array() as array<string>)") if base is None else base
    rating = F.lit(None).cast("int") if rating is None else rating
    label = F.lit(None).cast("string") if label is None else label
    rules = list(rules)
    hits = [condition(rule.when, names) for rule in rules]
    verdicts = [(hit, rule) for hit, rule in zip(hits, rules, strict=True) if rule.stars is not None]
    decided = F.coalesce(*[F.when(hit, F.lit(k)) for k, (hit, rule) in enumerate(zip(hits, rules, strict=True)) if rule.stars is not None], F.lit(len(rules)))
    stars = F.coalesce(*[F.when(hit, F.lit(rule.stars)) for hit, rule in verdicts], rating)
    reasons = F.filter(
        F.array(*[F.when(hit & (decided >= k), F.lit(rule.reason or rule.when)) for k, (hit, rule) in enumerate(zip(hits, rules, strict=True))]) if rules else F.expr("cast(array() as array<string>)"),
        lambda x: x.isNotNull(),
    )
    flags = [F.when(hit & (decided > k), F.lit(rule.label)) for k, (hit, rule) in enumerate(zip(hits, rules, strict=True)) if rule.stars is None and rule.label]
    flagged = F.coalesce(*reversed(flags), label) if flags else label
    own = [F.when(decided == k, F.lit(rule.label)) for k, rule in enumerate(rules) if rule.stars is not None and rule.label]
    return stars, F.coalesce(*own, flagged) if own else flagged, F.concat(base, reasons)
