"""What a pipeline returns: named columns over a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row

from weftgraph.sources.graph import Graph


def shown(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float) and x.is_integer():
        return str(int(x))
    if isinstance(x, Row):
        x = x.asDict()
        if [*x] == ["t", "i", "f", "b", "s"]:  # a value with its type
            return shown(next(v for v in (x["i"], x["f"], x["b"], x["s"]) if v is not None))
    if isinstance(x, dict):
        return "{" + ", ".join(f"{k}: {shown(x[k])}" for k in sorted(x)) + "}"
    return "[" + ", ".join(map(shown, x)) + "]" if isinstance(x, list) else str(x)


@dataclass(frozen=True)
class Result:
    """``columns`` may repeat; ``graph`` is the graph after the pipeline's changes."""

    df: DataFrame
    columns: list[str]
    graph: Graph

    def collect(self) -> list[Row]:
        return self.df.collect()

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def to_table(self, rows: int = 100) -> str:
        """The first rows as text in a frame."""
        if not self.columns:
            return "(no columns)"
        cells = [list(map(shown, r)) for r in self.df.limit(rows).collect()]
        widths = [max(len(x[i]) for x in (self.columns, *cells)) for i in range(len(self.columns))]
        line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
        said = lambda x: "| " + " | ".join(c.ljust(w) for c, w in zip(x, widths, strict=True)) + " |"
        return "\n".join([line, said(self.columns), line, *map(said, cells), line])
