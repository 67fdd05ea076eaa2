"""Expressions over bound variables, written with Python operators.

``p("n.age") > 20`` compares a property, ``v("n")`` is a whole node or edge, ``&``, ``|`` and
``~`` combine. An expression becomes a Spark column when it meets the rows that bind its
variables, because the rows know each property's type.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.errors import PlanError
from weftgraph.functions import values

Scope = Callable[[str, str | None], tuple[Column, T.DataType]]


@dataclass(frozen=True, eq=False)
class Expression:
    def __eq__(self, other: object) -> Expression:  # type: ignore[override]
        return Comparison("=", self, as_expression(other))

    def __ne__(self, other: object) -> Expression:  # type: ignore[override]
        return Comparison("<>", self, as_expression(other))

    def __lt__(self, other: object) -> Expression:
        return Comparison("<", self, as_expression(other))

    def __le__(self, other: object) -> Expression:
        return Comparison("<=", self, as_expression(other))

    def __gt__(self, other: object) -> Expression:
        return Comparison(">", self, as_expression(other))

    def __ge__(self, other: object) -> Expression:
        return Comparison(">=", self, as_expression(other))

    def __and__(self, other: object) -> Expression:
        return Logic("and", self, as_expression(other))

    def __or__(self, other: object) -> Expression:
        return Logic("or", self, as_expression(other))

    def __invert__(self) -> Expression:
        return Not(self)

    __hash__ = None  # type: ignore[assignment]

    def column(self, scope: Scope) -> tuple[Column, T.DataType]:
        raise NotImplementedError

    def condition(self, scope: Scope) -> Column:
        """As a filter: keeps what is exactly true."""
        x, t = self.column(scope)
        return values.true(x, values.kind(t))

    @property
    def name(self) -> str:
        return "expr"


@dataclass(frozen=True, eq=False)
class Literal(Expression):
    value: object

    def column(self, scope: Scope) -> tuple[Column, T.DataType]:
        kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}
        if type(self.value) not in kinds:
            raise PlanError(f"not a property value: {self.value!r}")
        literal = F.lit(self.value).cast("long") if type(self.value) is int else F.lit(self.value)
        return literal, kinds[type(self.value)]


@dataclass(frozen=True, eq=False)
class Property(Expression):
    variable: str
    key: str

    def column(self, scope: Scope) -> tuple[Column, T.DataType]:
        return scope(self.variable, self.key)

    @property
    def name(self) -> str:
        return f"{self.variable}.{self.key}"


@dataclass(frozen=True, eq=False)
class Entity(Expression):
    variable: str

    def column(self, scope: Scope) -> tuple[Column, T.DataType]:
        return scope(self.variable, None)

    @property
    def name(self) -> str:
        return self.variable


FLIPPED = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


@dataclass(frozen=True, eq=False)
class Comparison(Expression):
    op: str
    left: Expression
    right: Expression

    def column(self, scope: Scope) -> tuple[Column, T.DataType]:
        (a, ta), (b, tb) = self.left.column(scope), self.right.column(scope)
        ka, kb = values.kind(ta), values.kind(tb)
        if isinstance(self.left, Entity) and isinstance(self.right, Entity):  # one entity is what has one id
            a, b, ka, kb = a["id"], b["id"], values.WHOLE, values.WHOLE
        made = {
            "=": lambda: values.equal(a, ka, b, kb), "<>": lambda: ~values.equal(a, ka, b, kb),
            "<": lambda: values.less(a, ka, b, kb), "<=": lambda: values.at_most(a, ka, b, kb),
            ">": lambda: ~values.at_most(a, ka, b, kb), ">=": lambda: ~values.less(a, ka, b, kb),
        }
        return made[self.op](), T.BooleanType()

    def condition(self, scope: Scope) -> Column:
        for x, y, op in ((self.left, self.right, self.op), (self.right, self.left, FLIPPED[self.op])):
            if isinstance(x, Property) and isinstance(y, Literal) and y.value is not None:
                (column, t), (_, tv) = x.column(scope), y.column(scope)
                return values.against_literal(op, column, values.kind(t), y.value, values.kind(tv))
        return self.column(scope)[0]  # null-safe equality is a join key to Spark


@dataclass(frozen=True, eq=False)
class Logic(Expression):
    op: str
    left: Expression
    right: Expression

    def column(self, scope: Scope) -> tuple[Column, T.DataType]:
        a, b = (values.true(*_kinded(x.column(scope))) for x in (self.left, self.right))
        return (a & b if self.op == "and" else a | b), T.BooleanType()

    def condition(self, scope: Scope) -> Column:
        a, b = self.left.condition(scope), self.right.condition(scope)
        return a & b if self.op == "and" else a | b


@dataclass(frozen=True, eq=False)
class Not(Expression):
    inner: Expression

    def column(self, scope: Scope) -> tuple[Column, T.DataType]:
        return ~values.true(*_kinded(self.inner.column(scope))), T.BooleanType()


def _kinded(x: tuple[Column, T.DataType]) -> tuple[Column, str]:
    return x[0], values.kind(x[1])


def as_expression(x: object) -> Expression:
    return x if isinstance(x, Expression) else Literal(x)


def p(path: str) -> Property:
    """A property of a bound variable, as ``variable.key``."""
    variable, dot, key = path.partition(".")
    if not (variable and dot and key):
        raise PlanError(f"not of the form variable.key: {path!r}")
    return Property(variable, key)


def v(variable: str) -> Entity:
    """A whole bound node or edge."""
    return Entity(variable)
