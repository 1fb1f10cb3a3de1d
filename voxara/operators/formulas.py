"""Formulas over pixels: a small language of numbers, variables, operators and functions, read into a Column."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(<=|>=|==|!=|<>|:=|[-+*/%^()<>=,?:&|!]))")
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "exp": F.exp, "log": F.ln, "log10": F.log10, "log2": F.log2,
    "sqrt": F.sqrt, "abs": F.abs, "floor": lambda a: F.floor(a).cast("double"), "ceil": lambda a: F.ceil(a).cast("double"), "round": F.round, "sgn": F.signum, "pow": F.pow, "hypot": F.hypot,
    "min": F.least, "max": F.greatest, "clamp": lambda low, x, high: F.least(F.greatest(low, x), high), "if": lambda c, a, b: F.when(c != 0, a).otherwise(b),
}
CONSTANTS = {"pi": math.pi, "epsilon": 1e-10, "inf": math.inf, "true": 1.0, "false": 0.0}
_COMPARE = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<>": lambda a, b: a != b}


class _Reader:
    """Recursive descent: ternary, or, and, comparison, sum, product, sign, power."""

    def __init__(self, text: str, variables: dict[str, Column]):
        self.tokens, self.at, self.variables = [], 0, variables
        text, place = text.strip(), 0
        while place < len(text):
            m = _TOKEN.match(text, place)
            if not m:
                raise ValueError(f"No formula at: {text[place:]}")
            self.tokens.append(m.groups())
            place = m.end()

    def peek(self) -> str | None:
        return self.tokens[self.at][2] or self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> str | None:
        if (found := self.peek()) in wanted:
            self.at += 1
            return found
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise ValueError(f"{wanted} is missing in the formula")

    def chain(self, below: Callable[[], Column], operators: dict[str, Callable[[Column, Column], Column]]) -> Column:
        out = below()
        while op := self.take(*operators):
            out = operators[op](out, below())
        return out

    def formula(self) -> Column:
        out = self.chain(self.conjunction, {"or": self.truth(lambda a, b: a | b), "|": self.truth(lambda a, b: a | b)})
        if self.take("?"):
            a = self.formula()
            self.need(":")
            return F.when(out != 0, a).otherwise(self.formula())
        return out

    @staticmethod
    def truth(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        return lambda a, b: f(a != 0, b != 0).cast("double")

    def conjunction(self) -> Column:
        return self.chain(self.comparison, {"and": self.truth(lambda a, b: a & b), "&": self.truth(lambda a, b: a & b)})

    def comparison(self) -> Column:
        return self.chain(self.sum, {k: (lambda a, b, f=f: f(a, b).cast("double")) for k, f in _COMPARE.items()})

    def sum(self) -> Column:
        return self.chain(self.product, {"+": lambda a, b: a + b, "-": lambda a, b: a - b})

    def product(self) -> Column:
        return self.chain(self.signed, {"*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b), "%": lambda a, b: F.try_mod(a, b)})

    def signed(self) -> Column:
        if self.take("-"):
            return -self.signed()
        if self.take("!", "not"):
            return (self.signed() == 0).cast("double")
        return self.signed() if self.take("+") else self.power()

    def power(self) -> Column:
        base = self.atom()
        return F.pow(base, self.signed()) if self.take("^") else base

    def atom(self) -> Column:
        if self.at >= len(self.tokens):
            raise ValueError("The formula ends too early")
        number, name, _ = self.tokens[self.at]
        if number:
            self.at += 1
            return F.lit(float(number))
        if name:
            self.at += 1
            if self.take("("):
                if name not in FUNCTIONS:
                    raise ValueError(f"No function {name}; there are {', '.join(FUNCTIONS)}")
                arguments = [self.formula()]
                while self.take(","):
                    arguments.append(self.formula())
                self.need(")")
                return FUNCTIONS[name](*arguments)
            if name in CONSTANTS:
                return F.lit(CONSTANTS[name])
            if name not in self.variables:
                raise ValueError(f"No variable {name}; there are {', '.join(self.variables)}")
            return self.variables[name].cast("double")
        self.need("(")
        out = self.formula()
        self.need(")")
        return out


def column_of(text: str, variables: dict[str, Column]) -> Column:
    """The formula over the variables, in double; comparisons give 1 or 0, and division by 0 gives null, which callers turn to NaN."""
    reader = _Reader(text, variables)
    out = reader.formula()
    if reader.at < len(reader.tokens):
        raise ValueError(f"The formula ends before {reader.peek() or reader.tokens[reader.at][0]}")
    return out
