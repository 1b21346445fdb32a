"""Operators and their composition.

An operator maps DataFrame to DataFrame and is lazy; composition is `df.transform(op)`.
Pixel tables come wide (scene, t, y, x and one column per band) or long (scene, t, y, x, band, v).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL = ("scene", "y", "x")


class Operator:
    """A step with a name and parameters; `apply` does the work."""

    def __init__(self, **params):
        self.params = params

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df)

    def config(self) -> dict:
        return {"class": type(self).__name__, "config": {k: v for k, v in self.params.items() if not callable(v)}}

    def __or__(self, other: "Operator") -> "Sequential":
        return Sequential(self, other)


class Expression(Operator):
    """Adds one column computed from band columns, by the parameter names of `kernel`."""

    kernel: Callable[..., Column]
    defaults: dict = {}
    name = "v"

    def __init__(self, out: str | None = None, **params):
        super().__init__(**{**self.defaults, **params})
        self.out = out or self.name

    def column(self) -> Column:
        return type(self).kernel(**{k: F.col(v) if isinstance(v, str) else v for k, v in self.params.items()})

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.out, self.column())


def expression(name: str, kernel: Callable[..., Column], **defaults) -> type[Expression]:
    """A class of operators from a column function and its default bands and numbers."""
    return type(name, (Expression,), {"kernel": staticmethod(kernel), "defaults": defaults, "name": name.lower(), "__doc__": kernel.__doc__})


class Sequential(Operator):
    def __init__(self, *steps: Callable[[DataFrame], DataFrame]):
        super().__init__(steps=steps)
        self.steps = steps

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step(df)
        return df


class Identity(Operator):
    def apply(self, df: DataFrame) -> DataFrame:
        return df


class Lambda(Operator):
    def __init__(self, fn: Callable[[DataFrame], DataFrame]):
        super().__init__()
        self.fn = fn

    def apply(self, df: DataFrame) -> DataFrame:
        return self.fn(df)


class Const(Operator):
    """A column of one value."""

    def __init__(self, out: str, value):
        super().__init__(out=out, value=value)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.params["out"], F.lit(self.params["value"]))


class Tap(Operator):
    """Calls a function on the plan and passes it on."""

    def __init__(self, fn: Callable[[DataFrame], None]):
        super().__init__()
        self.fn = fn

    def apply(self, df: DataFrame) -> DataFrame:
        self.fn(df)
        return df


class Sink(Operator):
    """Ends with a writer: fn(df) writes."""

    def __init__(self, fn: Callable[[DataFrame], None]):
        super().__init__()
        self.fn = fn

    def apply(self, df: DataFrame) -> DataFrame:
        self.fn(df)
        return df


class Switch(Operator):
    """Chooses a branch when the plan is built."""

    def __init__(self, choose: Callable[[DataFrame], str], branches: dict[str, Operator]):
        super().__init__()
        self.choose, self.branches = choose, branches

    def apply(self, df: DataFrame) -> DataFrame:
        return self.branches[self.choose(df)](df)


class Fanout(Operator):
    """Several results of one input, by name."""

    def __init__(self, **branches: Callable[[DataFrame], DataFrame]):
        super().__init__()
        self.branches = branches

    def __call__(self, df: DataFrame) -> dict[str, DataFrame]:
        return {k: f(df) for k, f in self.branches.items()}


class Graph(Operator):
    """Named nodes, each (function, names of its inputs); `inputs` are given by name."""

    def __init__(self, nodes: dict[str, tuple], outputs: list[str]):
        super().__init__()
        self.nodes, self.outputs = nodes, outputs

    def __call__(self, **inputs: DataFrame) -> dict[str, DataFrame]:
        done = dict(inputs)

        def get(name: str) -> DataFrame:
            if name not in done:
                fn, args = self.nodes[name]
                done[name] = fn(*[get(a) for a in args])
            return done[name]

        return {k: get(k) for k in self.outputs}
