"""Guards, rates and attribute rules as text, turned into Columns.

Users write Spark SQL expressions over the columns of a match, with ``**``, ``//``, ``==``, ``a if c else b``, chained
comparisons and ``None`` besides.  A precedence-climbing parser makes a tree of the text, names and functions are held
against a whitelist, and the tree becomes a Column; no text is handed on and no Python is evaluated at run time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the functions an expression may call
FUNCTIONS = (
    "abs", "min", "max", "round", "int", "float", "bool", "len", "sum", "exp", "log", "sqrt", "sin", "cos", "tanh",
    "floor", "ceil", "isfinite", "clip", "softplus",
)
# Spark names that carry the same meaning
SPARK_NAMES = ("least", "greatest", "bround", "double", "boolean", "size", "ln", "pow", "coalesce", "isnan", "mod", "bigint")
KEYWORDS = ("and", "or", "not", "in", "is", "null", "none", "true", "false", "case", "when", "then", "else", "end", "as", "between", "div", "if", "cast")

# operators of two and three signs come before their first sign
_TOKEN = re.compile(
    r"\s*('(?:[^'\\]|\\.|'')*'|`[^`]+`|[A-Za-z_][A-Za-z_0-9]*|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?:[dDlLfF]|[bB][dD])?|<=>|\*\*|//|==|<>|!=|<=|>=|\|\||[-+*/%<>=(),.\[\]&|^~])"
)
_RENAME = {"round": "bround", "float": "double", "bool": "boolean", "len": "size", "log": "ln"}

Tree = tuple[Any, ...]
_COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "==": lambda a, b: a == b, "<>": lambda a, b: a != b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<=>": lambda a, b: a.eqNullSafe(b),
}
_OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "or": lambda a, b: a | b, "and": lambda a, b: a & b, "|": lambda a, b: a.bitwiseOR(b), "^": lambda a, b: a.bitwiseXOR(b), "&": lambda a, b: a.bitwiseAND(b),
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "||": F.concat, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b,
    "//": lambda a, b: F.floor(a / b), "div": lambda a, b: F.call_function("div", a, b), "**": F.pow,
}
#: how tightly operators bind; ``not`` lies between ``and`` and comparisons, a sign between products and powers
_BINDS = {"or": 1, "and": 2, "|": 5, "^": 6, "&": 7, "+": 8, "-": 8, "||": 8, "*": 9, "/": 9, "%": 9, "//": 9, "div": 9, "**": 11}
_NOT, _COMPARES, _SIGN = 3, 4, 10
_TERMS: dict[str, tuple[int, Callable[..., Column]]] = {
    "clip": (3, lambda x, low, high: F.least(F.greatest(x, low), high)),
    "softplus": (1, lambda x: F.when(x > 40, x).otherwise(F.log1p(F.exp(x)))),
    "isfinite": (1, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
    "sum": (1, lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, item: acc + item.cast("double"))),
}


class _Parser:
    """A tree of one expression: tuples of an operator and its operands."""

    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"an expression is a single term; what is {text[at:].strip()[:20]!r}?")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def whole(self) -> Tree:
        tree = self.choice()
        if self.at < len(self.tokens):
            raise ValueError(f"an expression is a single term; {self.tokens[self.at]!r} is left over")
        return tree

    def peek(self) -> str:
        """The next token, words that are keywords or operators in lower case."""
        t = self.tokens[self.at] if self.at < len(self.tokens) else ""
        return t.lower() if t.lower() in KEYWORDS else t

    def take(self, *wanted: str) -> str:
        t = self.peek()
        if not t or wanted and t not in wanted:
            raise ValueError(f"expected {' or '.join(wanted) or 'a term'}, found {t or 'the end'!r}")
        self.at += 1
        return t

    def met(self, *words: str) -> bool:
        """Whether the words come next; they are taken then."""
        here = self.at
        for w in words:
            if self.peek() != w:
                self.at = here
                return False
            self.at += 1
        return True

    def choice(self) -> Tree:
        value = self.climb(1)
        if self.met("if"):
            condition = self.climb(1)
            self.take("else")
            return ("case", [(condition, value)], self.choice())
        return value

    def climb(self, least: int) -> Tree:
        left = self.prefix()
        while True:
            op = self.peek()
            if op in _BINDS and _BINDS[op] >= least:
                self.at += 1
                # powers bind from the right, and a sign may stand before an exponent
                left = (op, left, self.climb(_SIGN if op == "**" else _BINDS[op] + 1))
            elif least <= _COMPARES and (compared := self.comparison(left)):
                left = compared
            else:
                return left

    def comparison(self, left: Tree) -> Tree | None:
        op = self.peek()
        if op in _COMPARISONS:
            whole, last = None, left
            while self.peek() in _COMPARISONS:
                op, right = self.take(), self.climb(_COMPARES + 1)
                link = (op, last, right)
                whole, last = link if whole is None else ("and", whole, link), right
            return whole
        if self.met("is"):
            negated = self.met("not")
            word = self.take("null", "none", "true", "false")
            tree = ("isnull", left) if word in ("null", "none") else ("<=>", left, ("literal", word))
        else:
            here = self.at
            negated = self.met("not")
            if self.met("in"):
                if self.met("(") or self.met("["):
                    tree = ("in", left, self.list_until(")" if self.tokens[self.at - 1] == "(" else "]"))
                else:
                    tree = ("within", left, self.climb(_COMPARES + 1))
            elif self.met("between"):
                low = self.climb(_COMPARES + 1)
                self.take("and")
                tree = ("and", (">=", left, low), ("<=", left, self.climb(_COMPARES + 1)))
            else:
                self.at = here
                return None
        return ("not", tree) if negated else tree

    def list_until(self, end: str) -> list[Tree]:
        out: list[Tree] = []
        while not self.met(end):
            if out:
                self.take(",")
            out.append(self.choice())
        return out

    def prefix(self) -> Tree:
        if self.met("not"):
            return ("not", self.climb(_NOT))
        for sign in "-+~":
            if self.met(sign):
                return (f"unary{sign}", self.climb(_SIGN))
        return self.suffixes(self.primary())

    def suffixes(self, tree: Tree) -> Tree:
        while self.met("["):
            tree = ("item", tree, self.choice())
            self.take("]")
        return tree

    def primary(self) -> Tree:
        t = self.take()
        if t == "(":
            tree = self.choice()
            self.take(")")
            return tree
        if t == "[":
            return ("array", self.list_until("]"))
        if t in ("null", "none", "true", "false") or t[0] in "'0123456789" or t[0] == "." and len(t) > 1:
            return ("literal", t)
        if t == "case":
            return self.case()
        if t == "cast":
            self.take("(")
            value, kind = self.choice(), []
            self.take("as")
            depth = 1
            while depth:
                kind.append(self.take())
                depth += (kind[-1] == "(") - (kind[-1] == ")")
            return ("cast", value, " ".join(kind[:-1]))
        if t in KEYWORDS or not re.match(r"[A-Za-z_`]", t):
            raise ValueError(f"{t!r} is not a term")
        if self.met("("):
            return ("call", t, self.list_until(")"))
        while self.met("."):
            t += f".{self.take()}"
        return ("name", t)

    def case(self) -> Tree:
        value = None if self.peek() == "when" else self.choice()
        branches, other = [], ("literal", "null")
        while self.met("when"):
            condition = self.choice()
            self.take("then")
            branches.append((condition if value is None else ("=", value, condition), self.choice()))
        if not branches:
            raise ValueError("a case without a branch")
        if self.met("else"):
            other = self.choice()
        self.take("end")
        return ("case", branches, other)


def _names(tree: Any) -> Iterator[str]:
    if isinstance(tree, list) or isinstance(tree, tuple) and tree and isinstance(tree[0], tuple):
        for x in tree:
            yield from _names(x)
    elif isinstance(tree, tuple) and tree:
        if tree[0] == "name":
            yield tree[1].strip("`")
        elif tree[0] != "literal":
            for x in tree[1:]:
                yield from _names(x)


def names_in(text: str) -> set[str]:
    """Column names an expression mentions."""
    return set(_names(_Parser(text).whole()))


def checked(text: str, columns: Iterable[str]) -> Column:
    """The expression as a Column, or ValueError for an unknown name or function."""
    tree, known = _Parser(text).whole(), set(columns)
    unknown = sorted(n for n in set(_names(tree)) if n not in known and n.split(".")[0] not in known)
    if unknown:
        raise ValueError(f"unknown names in expression: {unknown}")
    return _column(tree)


def _call(name: str, args: list[Column]) -> Column:
    lower = name.lower()
    if lower in _TERMS:
        arity, build = _TERMS[lower]
        if len(args) != arity:
            raise ValueError(f"{name} takes {arity} arguments")
        return build(*args)
    if lower in ("min", "max"):
        # of one list, or of several values
        return (F.array_min if lower == "min" else F.array_max)(args[0]) if len(args) == 1 else (F.least if lower == "min" else F.greatest)(*args)
    if lower not in FUNCTIONS and lower not in SPARK_NAMES:
        raise ValueError(f"function {name!r} is not allowed")
    return F.call_function(_RENAME.get(lower, lower), *args)


def _column(tree: Tree) -> Column:
    op, *rest = tree
    if op == "literal":
        # one token only: a number, a quoted text or a word that stands for itself
        return F.expr("null" if rest[0] == "none" else rest[0])
    if op == "name":
        return F.col(rest[0])
    if op == "call":
        return _call(rest[0], [_column(a) for a in rest[1]])
    if op == "case":
        out = None
        for condition, value in rest[0]:
            out = (F if out is None else out).when(_column(condition), _column(value))
        return out.otherwise(_column(rest[1]))
    if op == "cast":
        return _column(rest[0]).cast(rest[1])
    if op == "in":
        return _column(rest[0]).isin(*[_column(x) for x in rest[1]])
    if op == "array":
        return F.array(*[_column(x) for x in rest[0]])
    args = [_column(x) for x in rest]
    if op in _COMPARISONS:
        return _COMPARISONS[op](*args)
    if op in _OPERATIONS:
        return _OPERATIONS[op](*args)
    return {
        "not": lambda a: ~a, "unary-": lambda a: -a, "unary+": lambda a: a, "unary~": F.bitwise_not, "isnull": lambda a: a.isNull(),
        "within": lambda a, b: F.array_contains(b, a), "item": lambda a, b: a[b],
    }[op](*args)


def with_context(df: DataFrame, parameters: Mapping[str, float] | None = None, memory: Mapping[str, float] | None = None, time: float | None = None) -> DataFrame:
    """Add parameters and memory as ``p_<path>`` / ``z_<path>`` constant columns."""
    cols = {f"p_{k.replace('.', '_')}": F.lit(v) for k, v in (parameters or {}).items()}
    cols.update({f"z_{k.replace('.', '_')}": F.lit(v) for k, v in (memory or {}).items()})
    if time is not None:
        cols["time"] = F.lit(float(time))
    return df.withColumns(cols) if cols else df


def dead_zone_sign(x: Column, eps: float = 0.0) -> Column:
    """1, 0 or -1 with a band of ``eps`` around zero; null stays null."""
    if eps < 0:
        raise ValueError(f"the band around zero cannot be {eps}")
    return F.when(x > eps, 1).when(x < -eps, -1).when(x.isNotNull(), 0)


def content_hash(columns: Iterable[str]) -> Column:
    """sha256 of the type-preserving JSON of columns in name order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def entity_id(namespace: Column, counter: Column) -> Column:
    """``%016x:%016x``; string order equals (namespace, counter) order."""
    part = lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 16, "0"))
    return F.concat(part(namespace), F.lit(":"), part(counter))


def parse_entity_id(text: Column) -> Column:
    """STRUCT<namespace, counter>, null fields where the text is malformed."""
    ok = text.rlike("^[0-9a-f]{16}:[0-9a-f]{16}$")
    part = lambda i: F.when(ok, F.conv(F.split(text, ":")[i], 16, 10).cast("decimal(20,0)").cast("long"))
    return F.struct(part(0).alias("namespace"), part(1).alias("counter"))


def changed_paths(before: Column, after: Column, prefix: str = "") -> Column:
    """Dotted paths added, removed or changed between two flattened maps."""
    merged = F.map_zip_with(before, after, lambda k, a, b: ~a.eqNullSafe(b))
    keys = F.array_sort(F.map_keys(F.map_filter(merged, lambda k, v: v)))
    return F.transform(keys, lambda k: F.concat(F.lit(prefix), k)) if prefix else keys
