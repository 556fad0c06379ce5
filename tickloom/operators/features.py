"""Technical features as layered column expressions.

A feature is a builder that records *layers* on a :class:`Scope`: window layers (ordinary column
expressions over a bounded frame) and scan layers (linear recursions).  Layers of all features of a
genome are merged, so any number of features costs one exchange and one sort, plus one pass per
scan depth.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.num import c, div
from tickloom.operators.blocks import GRID, Grid, core_only, group_window, with_halo
from tickloom.operators.scan import RunLength, Scan, run_scans
from tickloom.session import materialize


@dataclass
class Layer:
    kind: str
    cols: dict = field(default_factory=dict)
    look: int = 0


class Scope:
    """Records the layers of one feature and offers guarded window helpers."""

    def __init__(self, prefix: str, keys: tuple[str, ...] = ("symbol",)):
        self.prefix = prefix
        self.layers: list[Layer] = []
        self.keys = keys
        self.win = group_window(keys)
        self._look = 0

    # -- frames -----------------------------------------------------------------
    def frame(self, n: int):
        self._look = max(self._look, n)
        return self.win.rowsBetween(-(n - 1), 0)

    def full(self, agg: Callable[[Column], Column], x, n: int) -> Column:
        """Aggregate over the last n rows, NULL until n values are there."""
        x, w = c(x), self.frame(n)
        return F.when(F.count(x).over(w) == n, agg(x).over(w))

    def avg(self, x, n):
        return self.full(F.avg, x, n)

    def sum(self, x, n):
        return self.full(F.sum, x, n)

    def max(self, x, n):
        return self.full(F.max, x, n)

    def min(self, x, n):
        return self.full(F.min, x, n)

    def std(self, x, n):
        return self.full(F.stddev_samp, x, n)

    def pstd(self, x, n):
        return self.full(F.stddev_pop, x, n)

    def array(self, x, n) -> Column:
        return self.full(F.collect_list, x, n)

    def quantile(self, x, q: float, n: int) -> Column:
        return self.full(lambda v: F.percentile(v, F.lit(q)), x, n)

    def corr(self, x, y, n: int) -> Column:
        """Pearson correlation of n complete pairs; NULL when either side is constant."""
        w, x, y = self.frame(n), c(x), c(y)
        both = F.when(x.isNotNull() & y.isNotNull(), 1)
        spread = F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)
        return F.when(F.count(both).over(w) == n, F.try_divide(F.covar_pop(x, y).over(w), spread))

    def lag(self, x, n: int = 1) -> Column:
        self._look = max(self._look, n)
        return F.lag(c(x), n).over(self.win)

    def diff(self, x, n: int = 1) -> Column:
        return c(x) - self.lag(x, n)

    def pct(self, x, n: int = 1) -> Column:
        prev = self.lag(x, n)
        return div(c(x) - prev, prev)

    # -- recording ----------------------------------------------------------------
    def _open(self, kind: str, text: str) -> Layer:
        """First layer of this kind after every layer the expression refers to."""
        after = max((i for i, l in enumerate(self.layers) if any(n in text for n in l.cols)), default=-1)
        for layer in self.layers[after + 1:]:
            if layer.kind == kind:
                return layer
        self.layers.append(Layer(kind))
        return self.layers[-1]

    def let(self, name: str, expr: Column) -> Column:
        full = f"{self.prefix}~{name}~"
        layer = self._open("win", str(expr))
        layer.cols[full] = expr
        layer.look = max(layer.look, self._look)
        self._look = 0
        return F.col(f"`{full}`")

    def scan(self, name: str, factor, inject, seed: Column | None = None, valid: Column | None = None,
             first: int = 0, feeds: tuple = ()) -> Column:
        full = f"{self.prefix}~{name}~".replace("~", "_z")
        text = " ".join(str(x) for x in (factor, inject, seed, valid))
        if feeds:  # same pass as the states it is fed by
            layer = next(l for l in self.layers if l.kind == "scan" and feeds[0][0] in l.cols)
        else:
            layer = self._open("scan", text)
        layer.cols[full] = Scan(full, factor, inject, seed, valid, first, feeds)
        return F.col(full)

    def run_length(self, name: str, cond: Column) -> Column:
        full = f"{self.prefix}~{name}~".replace("~", "_z")
        ok = self.let(name + "_c", F.coalesce(cond, F.lit(False)))
        self._open("scan", str(ok)).cols[full] = RunLength(full, ok)
        return F.col(full)

    # -- smoothers --------------------------------------------------------------------
    def mask(self, y: Column, first: int) -> Column:
        return F.when(F.col("bar_idx") >= first, y)

    def ewm(self, name: str, x: Column, alpha: float, lead: int = 0, shown: int = 0, gaps: bool = False) -> "State":
        """Exponential smoother of a series with ``lead`` leading NULLs, seeded by its first value.

        ``gaps``: NULLs may also occur later; they leave the state unchanged.  The result can be used
        as a column (NULL before row ``shown``) or fed into another smoother.
        """
        if isinstance(x, State):
            self.scan(name, 1.0 - alpha, alpha, first=lead, feeds=x.terms)
        else:
            v = self.let(name + "_x", c(x))
            self.scan(name, 1.0 - alpha, F.lit(alpha) * v, seed=v, valid=v.isNotNull() if gaps else None, first=lead)
        return State(self, ((f"{self.prefix}_z{name}_z", 1.0),), max(lead, shown))

    def ema(self, name: str, x, n: int, lead: int = 0, guard: bool = True, gaps: bool = False) -> "State":
        """EMA of span n over a series with ``lead`` leading NULLs."""
        return self.ewm(name, x, 2.0 / (n + 1), lead, lead + n - 1 if guard else lead, gaps)

    def wilder(self, name: str, x, n: int, lead: int = 0, guard: bool = True) -> Column:
        """Wilder smoothing seeded by the mean of the first n values."""
        v = self.let(name + "_x", c(x))
        k = F.col("bar_idx") - lead + 1
        upto = F.least(k, F.lit(n)).cast("double")
        y = self.scan(name, F.when(k <= 1, F.lit(1.0)).otherwise((upto - 1) / upto), v / upto, valid=k >= 1)
        return self.mask(y, lead + n - 1 if guard else lead)

    def cumsum(self, name: str, x: Column) -> Column:
        v = self.let(name + "_x", F.coalesce(x, F.lit(0.0)))
        return self.scan(name, 1.0, v)


class State:
    """Linear combination of scan states, usable as a column or as input of the next smoother."""

    def __init__(self, scope: Scope, terms: tuple, first: int):
        self.scope, self.terms, self.first = scope, terms, first

    @property
    def col(self) -> Column:
        total = sum((F.lit(k) * F.col(n) if k != 1.0 else F.col(n) for n, k in self.terms[1:]), F.col(self.terms[0][0]))
        return self.scope.mask(total, self.first) if self.first else total

    def __sub__(self, other: "State") -> "State":
        return State(self.scope, self.terms + tuple((n, -k) for n, k in other.terms), max(self.first, other.first))


def apply_layers(bars: DataFrame, scopes: list[Scope], grid: Grid = GRID, keep: list[str] | None = None) -> DataFrame:
    """Evaluate the merged layers of several scopes over bars."""
    keys = scopes[0].keys
    queue = [list(s.layers) for s in scopes]
    plan: list[tuple[str, dict, int]] = []
    while any(queue):
        kind = "win" if any(q and q[0].kind == "win" for q in queue) else "scan"
        cols, look = {}, 0
        for q in queue:
            if q and q[0].kind == kind:
                layer = q.pop(0)
                cols.update(layer.cols)
                look = max(look, layer.look)
        plan.append((kind, cols, look))
    parts, halos = [0], []
    for kind, _, look in plan:
        if kind == "scan":
            parts.append(0)
        else:
            parts[-1] += look
    halo = grid.halo_for(parts) if max(parts) > 0 else 0
    df = with_halo(bars, halo, grid)
    passes = 0
    for kind, cols, _ in plan:
        if kind == "win":
            df = df.withColumns(cols)
            continue
        if passes:  # a pass reads its input twice; without this a second pass would double all work below it
            df = materialize(df)
        passes += 1
        df = run_scans(df, list(cols.values()), keys, halo=halo, grid=grid)
    return core_only(df)


@dataclass(frozen=True)
class FeatureDef:
    """Registry entry: builder, category, parameters (name, type, min, max, default), output keys."""

    feature_id: str
    category: str
    build: Callable[..., dict[str, Column]] | None
    params: tuple = ()
    outputs: dict | None = None
    native: Callable | None = None  # feature that is a state machine: (bars, params) -> bars + columns
    context: tuple = ()

    def defaults(self) -> dict:
        return {p[0]: p[4] for p in self.params}


def column_name(feature_id: str, output: str) -> str:
    return f"{feature_id}__{output}"


class Registry:
    """Known features.  User features are added with :meth:`add`; nothing is ever exec'd."""

    def __init__(self):
        self.features: dict[str, FeatureDef] = {}

    def add(self, feature: FeatureDef, overwrite: bool = False) -> None:
        if feature.feature_id in self.features and not overwrite:
            raise ValueError(f"FEATURE_EXISTS: {feature.feature_id}")
        self.features[feature.feature_id] = feature

    def __getitem__(self, feature_id: str) -> FeatureDef:
        if feature_id not in self.features:
            raise KeyError(f"FEATURE_NOT_REGISTERED: {feature_id}")
        return self.features[feature_id]

    def copy(self) -> "Registry":
        out = Registry()
        out.features = dict(self.features)
        return out


REGISTRY = Registry()


def feature(feature_id: str, category: str, outputs: dict, *params, context: tuple = ()):
    """Register a builder.  ``outputs`` maps the logical output key to the column suffix."""
    def wrap(fn):
        REGISTRY.add(FeatureDef(feature_id, category, fn, tuple(params), outputs, None, context))
        return fn
    return wrap


def native_feature(feature_id: str, category: str, outputs: dict, *params):
    """Register a feature computed by a state machine over whole bars."""
    def wrap(fn):
        REGISTRY.add(FeatureDef(feature_id, category, None, tuple(params), outputs, fn))
        return fn
    return wrap


def int_param(name: str, lo: int, hi: int, step: int, default: int) -> tuple:
    return (name, "int", float(lo), float(hi), default, float(step))


def float_param(name: str, lo: float, hi: float, step: float, default: float) -> tuple:
    return (name, "float", lo, hi, default, step)


def compute_genome(bars: DataFrame, genome: dict[str, dict], registry: Registry = REGISTRY, grid: Grid = GRID,
                   warmup: str = "null") -> DataFrame:
    """Bars plus one ``FEATURE__output`` column per output of every feature of the genome.

    ``warmup='zero'`` forward-fills and zero-fills the feature columns as a last step.
    """
    from tickloom.sources.bars import forward_fill

    keep, scopes, outs, machines = list(bars.columns), [], {}, []
    for fid, params in genome.items():
        spec = registry[fid]
        args = {**spec.defaults(), **(params or {})}
        if spec.native is not None:
            machines.append((spec, args))
            continue
        scope = Scope(fid)
        for out, expr in spec.build(scope, **args).items():
            outs[column_name(fid, out)] = expr
            scope.let("out_" + out, expr)
        scopes.append((fid, scope))
    if scopes:
        df = apply_layers(bars, [s for _, s in scopes], grid)
        names = [n for n in outs]
        df = df.select(*keep, *[F.col(f"`{n.split('__', 1)[0]}~out_{n.split('__', 1)[1]}~`").alias(n) for n in names])
    else:
        df = bars
    for spec, args in machines:
        df = spec.native(df, spec.feature_id, grid=grid, **args)
    if warmup == "zero":
        new = [n for n in df.columns if n not in keep]
        finite = {n: F.when(F.isnan(n) | F.abs(n).isin(float("inf")), None).otherwise(F.col(n).cast("double")) for n in new}
        df = forward_fill(df.withColumns(finite), new, grid=grid)
    return df


def resolve(columns: list[str], feature_id: str, output: str = "value", registry: Registry = REGISTRY,
            lenient: bool = False) -> str:
    """(feature, output key) to a column name; strict unless ``lenient`` (unique prefix match)."""
    spec = registry.features.get(feature_id)
    if spec is not None:
        if output not in (spec.outputs or {}):
            reason = f"OUTPUT_KEY_UNDEFINED: {feature_id}.{output}"
        else:
            name = column_name(feature_id, spec.outputs[output])
            if name in columns:
                return name
            reason = f"COLUMN_NOT_FOUND: {name}"
    else:
        reason = f"FEATURE_NOT_REGISTERED: {feature_id}"
    if lenient:
        hits = [n for n in columns if n.startswith(feature_id + "__")]
        if len(hits) == 1:
            return hits[0]
        if len(hits) > 1:
            raise LookupError(f"AMBIGUOUS: {feature_id}")
    raise LookupError(reason)
