"""Lines: column expressions over ordered series, planned in as few stages as their nesting needs.

A `Line` is a node of an expression graph: columns, literals, scalar operations, window functions over one symbol's
rows in order, and folds. `with_lines` adds lines to a frame: equal nodes are worked out once, all window functions of one
depth go into one select (one window operator over one exchange and sort), and folds of one depth into one ordered pass
over the partitions, which holds a few states and never a symbol's whole series. `to_sql` writes the same graph as SQL.

Null rule: a rolling value is null until its frame is full; nulls spread through scalar operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.functions.folds import FOLDS
from barloom.plans.ordered import in_order


class Line:
    """kind: col, lit, op (a template with {0} {1} ...), win (a template; {w} is the window) or fold."""

    __slots__ = ("kind", "what", "args", "params", "depth", "key")

    def __init__(self, kind: str, what, args: Iterable = (), params: tuple = ()):
        self.kind, self.what, self.args, self.params = kind, what, tuple(line(a) for a in args), params
        below = max((a.depth for a in self.args), default=0)
        self.depth = below + (kind in ("win", "fold"))
        self.key = (kind, what, params, tuple(a.key for a in self.args))

    def _op(self, template: str, *others) -> Line:
        return Line("op", template, (self, *others))

    def __add__(self, o):
        return self._op("({0} + {1})", o)

    def __radd__(self, o):
        return line(o) + self

    def __sub__(self, o):
        return self._op("({0} - {1})", o)

    def __rsub__(self, o):
        return line(o) - self

    def __mul__(self, o):
        return self._op("({0} * {1})", o)

    def __rmul__(self, o):
        return line(o) * self

    def __truediv__(self, o):
        """A quotient; null where the divisor is 0."""
        return self._op("({0} / nullif({1}, 0))", o)

    def __rtruediv__(self, o):
        return line(o) / self

    def __floordiv__(self, o):
        return self._op("floor({0} / nullif({1}, 0))", o)

    def __mod__(self, o):
        """A remainder with the divisor's sign."""
        return self - (self // o) * o

    def __pow__(self, o):
        return self._op("pow({0}, {1})", o)

    def __rpow__(self, o):
        return line(o) ** self

    def __neg__(self):
        return self._op("(-{0})")

    def __abs__(self):
        return self._op("abs({0})")

    def _compare(self, sign: str, o) -> Line:
        return self._op("CASE WHEN {0} " + sign + " {1} THEN CAST(1 AS DOUBLE) WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN CAST(0 AS DOUBLE) END", o)

    def __lt__(self, o):
        return self._compare("<", o)

    def __le__(self, o):
        return self._compare("<=", o)

    def __gt__(self, o):
        return self._compare(">", o)

    def __ge__(self, o):
        return self._compare(">=", o)

    def __eq__(self, o):  # noqa: PYI032
        return self._compare("=", o)

    def __ne__(self, o):
        return self._compare("<>", o)

    __hash__ = None

    def __call__(self, ago: int) -> Line:
        """x(-k): k rows back; x(k): k rows ahead."""
        return lag(self, -ago) if ago <= 0 else lead(self, ago)


def line(x) -> Line:
    if isinstance(x, Line):
        return x
    return Line("col", x) if isinstance(x, str) else Line("lit", None if x is None else float(x))


def col(name: str) -> Line:
    return Line("col", name)


def op(template: str, *args) -> Line:
    return Line("op", template, args)


_ALL = "PARTITION BY {key} ORDER BY {order}"


def lag(x, k: int) -> Line:
    return line(x) if k == 0 else Line("win", f"lag({{0}}, {k}) OVER ({_ALL})", (x,))


def lead(x, k: int) -> Line:
    return Line("win", f"lead({{0}}, {k}) OVER ({_ALL})", (x,))


def row_number() -> Line:
    return Line("win", f"CAST(row_number() OVER ({_ALL}) AS DOUBLE)")


def over(template: str, *args) -> Line:
    """An aggregate over all rows up to this one, or any frame that the template names after {w}."""
    return Line("win", template.replace("{w}", _ALL), args)


def rolling(function: str, period: int, *args) -> Line:
    """An aggregate of the last `period` values; null until there are as many."""
    frame = f"({_ALL} ROWS BETWEEN {period - 1} PRECEDING AND CURRENT ROW)"
    values = ", ".join(f"{{{k}}}" for k in range(len(args)))
    full = " AND ".join(f"count({{{k}}}) OVER {frame} = {period}" for k in range(len(args)))
    return Line("win", f"CASE WHEN {full} THEN {function}({values}) OVER {frame} END", args)


def cumulative(function: str, x) -> Line:
    return Line("win", f"{function}({{0}}) OVER ({_ALL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", (x,))


def last_known(x) -> Line:
    """The last value that isn't null, up to this row."""
    return Line("win", f"last_value({{0}} IGNORE NULLS) OVER ({_ALL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", (x,))


def extreme_row(period: int, x, oldest: bool = False) -> Line:
    """The row number of the largest of the last `period` values, the most recent or the oldest of equal ones."""
    n = row_number()
    frame = f"({_ALL} ROWS BETWEEN {period - 1} PRECEDING AND CURRENT ROW)"
    found = Line("win", f"CASE WHEN count({{0}}) OVER {frame} = {period} THEN max(struct_of({{0}}, {{1}})) OVER {frame} END", (x, -n if oldest else n))
    at = op("({0}).n", found)
    return -at if oldest else at


def values(period: int, x) -> Line:
    """The last `period` values as an array, oldest first; null until there are as many."""
    frame = f"({_ALL} ROWS BETWEEN {period - 1} PRECEDING AND CURRENT ROW)"
    return Line("win", f"CASE WHEN count({{0}}) OVER {frame} = {period} THEN array_of({{0}}) OVER {frame} END", (x,))


def fold(name: str, *args, params: tuple = ()) -> Line:
    return Line("fold", name, args, params)


class _Plan:
    """Names for the materialised nodes, stage by stage."""

    def __init__(self, lines: dict[str, Line], key: str, order: str, dialect: str):
        self.key, self.order, self.dialect, self.names, self.stages = key, order, dialect, {}, []
        nodes: dict = {}

        def visit(x: Line) -> None:
            for a in x.args:
                visit(a)
            if x.kind in ("win", "fold"):
                nodes.setdefault(x.key, x)

        for x in lines.values():
            visit(x)
        for depth in sorted({x.depth for x in nodes.values()}):
            for kind in ("win", "fold"):
                some = [x for x in nodes.values() if x.depth == depth and x.kind == kind]
                if some:
                    self.stages.append((kind, [(f"_l{len(self.names) + k}", x) for k, x in enumerate(some)]))
                    self.names |= {x.key: n for n, x in self.stages[-1][1]}

    def text(self, x: Line, top: bool = False) -> str:
        if not top and x.key in self.names:
            return self.names[x.key]
        if x.kind == "col":
            return x.what
        if x.kind == "lit":
            return "NULL" if x.what is None else f"CAST({x.what!r} AS DOUBLE)"
        out = x.what.replace("{key}", self.key).replace("{order}", self.order)
        for k, a in enumerate(x.args):
            out = out.replace(f"{{{k}}}", self.text(a))
        if self.dialect == "spark":
            return _structs(out, "named_struct('v', {0}, 'n', {1})").replace("array_of(", "collect_list(").replace(" IGNORE NULLS) OVER", ") IGNORE NULLS OVER")
        return _structs(out, "{{'v': {0}, 'n': {1}}}").replace("array_of(", "list(").replace("size(filter(", "len(list_filter(").replace("v -> ", "lambda v: ")


def _structs(text: str, form: str) -> str:
    while "struct_of(" in text:
        a = text.index("struct_of(")
        depth, k, cut = 0, a + len("struct_of"), None
        while True:
            c = text[k]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1 and cut is None:
                cut = k
            if depth == 0:
                break
            k += 1
        text = text[:a] + form.format(text[a + len("struct_of(") : cut], text[cut + 1 : k].strip()) + text[k + 1 :]
    return text


def with_lines(df: DataFrame, lines: dict[str, Line], key: str = "symbol", order: str = "dt") -> DataFrame:
    """The frame with the given lines as columns behind its own. `key` names a symbol's rows, `order` puts them in order.

    `key` and `order` are SQL lists of columns; rows that tie in `order` should not exist.
    """
    plan, base, sorted_ = _Plan(lines, key, order, "spark"), df.columns, False
    names = [k.strip() for k in key.split(",")]
    for kind, nodes in plan.stages:
        if kind == "win":
            df, sorted_ = df.selectExpr("*", *(f"{plan.text(x, True)} AS {n}" for n, x in nodes)), False
            continue
        inputs = [(f"{n}_{k}", plan.text(a)) for n, x in nodes for k, a in enumerate(x.args)]
        if not sorted_:
            df = in_order(df, names, *(o.strip() for o in order.split(",")))
        df, sorted_ = _fold_stage(df.selectExpr("*", *(f"CAST({text} AS DOUBLE) AS {n}" for n, text in inputs)), names, nodes), True
    return df.selectExpr(*base, *(f"{plan.text(x)} AS {n}" for n, x in lines.items()))


def _fold_stage(df: DataFrame, names: list[str], nodes: list[tuple[str, Line]]) -> DataFrame:
    keep = [c for c in df.columns if not any(c.startswith(f"{n}_") for n, _ in nodes)]
    makers = [(n, x.what, x.params, [f"{n}_{k}" for k in range(len(x.args))]) for n, x in nodes]

    def codes(column: pa.Array) -> np.ndarray:
        """Whole numbers that tell a column's values apart within the batch; a null is a value."""
        return pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)

    def several(fold, arrays: list[np.ndarray], valid: list[np.ndarray]) -> np.ndarray:
        if hasattr(fold, "many"):
            return fold.many(arrays, np.logical_and.reduce(valid))
        columns = [[v if ok else None for v, ok in zip(x.tolist(), good.tolist(), strict=True)] for x, good in zip(arrays, valid, strict=True)]
        return np.array([np.nan if v is None else v for v in map(fold.step, *columns)], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, folds = object(), []
        for batch in batches:
            table = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            n = batch.num_rows
            new = np.zeros(n, bool)
            new[:1] = True
            for c in names:
                own = codes(table[c])
                new[1:] |= own[1:] != own[:-1]
            edges = [*np.flatnonzero(new).tolist(), n]
            inputs = {c: (pc.fill_null(table[c], np.nan).to_numpy(zero_copy_only=False), table[c].is_valid().to_numpy(zero_copy_only=False)) for *_, columns in makers for c in columns}
            out = [np.full(n, np.nan) for _ in makers]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                now = tuple(table[c][a].as_py() for c in names)
                if now != last:
                    last, folds = now, [FOLDS[what](*params) for _, what, params, _ in makers]
                for k, (fold, (*_, columns)) in enumerate(zip(folds, makers, strict=True)):
                    out[k][a:b] = several(fold, [inputs[c][0][a:b] for c in columns], [inputs[c][1][a:b] for c in columns])
            yield pa.RecordBatch.from_arrays([*(table[c] for c in keep), *(pa.array(v, pa.float64(), from_pandas=True) for v in out)], [*keep, *(n for n, *_ in makers)])

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n, _ in nodes])
    return df.mapInArrow(run, schema)


def to_sql(source: str, lines: dict[str, Line], select: str, key: str = "symbol", order: str = "dt") -> str | None:
    """The same lines as one DuckDB query over `source` (a query); `select` is the final select list. None if a fold has no SQL."""
    plan = _Plan(lines, key, order, "duckdb")
    names = [k.strip() for k in key.split(",")]
    ctes, now = [f"s0 AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS _rn FROM ({source}))"], "s0"
    for i, (kind, nodes) in enumerate(plan.stages, 1):
        if kind == "win":
            ctes.append(f"s{i} AS MATERIALIZED (SELECT *, {', '.join(f'{plan.text(x, True)} AS {n}' for n, x in nodes)} FROM {now})")
        else:
            joins = []
            for n, x in nodes:
                spec = FOLDS[x.what]
                if spec.SQL is None:
                    return None
                inputs = ", ".join(f"CAST({plan.text(a)} AS DOUBLE) AS x{k}" for k, a in enumerate(x.args))
                ctes.append(f"i{n} AS MATERIALIZED (SELECT {key}, _rn, {inputs} FROM {now})")

                def put(text: str, x=x) -> str:
                    return re.sub(r"\bp(\d)\b", lambda m: repr(x.params[int(m[1])]), text)

                states = list(spec.SQL)
                xs = ", ".join(f"i.x{k}" for k in range(len(x.args)))
                first = ", ".join(f"CAST({re.sub(r'\bx(\d)\b', r'i.x\1', put(a))} AS DOUBLE) AS {s}" for s, (a, _) in spec.SQL.items())
                later = ", ".join(f"CAST({re.sub(r'\bx(\d)\b', r'i.x\1', put(b))} AS DOUBLE)" for _, b in spec.SQL.values())
                ks = ", ".join(f"i.{k}" for k in names)
                ctes.append(f"r{n} AS (SELECT {ks}, i._rn, {xs}, {first} FROM i{n} i WHERE i._rn = 1 UNION ALL SELECT {ks}, i._rn, {xs}, {later} FROM r{n} r JOIN i{n} i ON {' AND '.join(f'i.{k} = r.{k}' for k in names)} AND i._rn = r._rn + 1)")
                out = put(getattr(spec, "OUT", f"CASE WHEN {spec.SKIP} THEN NULL ELSE {states[-1]} END"))
                joins.append(f"JOIN (SELECT {key}, _rn, {out} AS {n} FROM r{n}) USING ({key}, _rn)")
            ctes.append(f"s{i} AS MATERIALIZED (SELECT * FROM {now} {' '.join(joins)})")
        now = f"s{i}"
    final = f"SELECT *, {', '.join(f'{plan.text(x)} AS {n}' for n, x in lines.items())} FROM {now}"
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT {select} FROM ({final})"
