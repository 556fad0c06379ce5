"""Trading rules as Catalyst expressions.

A rule such as ``MOMENTUM_RSI_V1 < 30 and (close cross_up TREND_SMA_V1 or not volume > [q0.5])`` is rewritten
term by term and handed to Spark's own expression parser.  A comparison with a missing value is false
(``!=`` is true), so the rest is ordinary two-valued logic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import settings as S
from tickloom.operators.features import REGISTRY, Registry, resolve
from tickloom.operators.quantiles import exact_quantiles
from tickloom.session import materialize

TERM = re.compile(r"`?([A-Za-z_][\w.\-]*)`?\s*(<=|>=|==|!=|<|>|cross_up|cross_down)\s*(\[q[0-9.]+\]|-?[0-9.]+(?:[eE]-?\d+)?|`?[A-Za-z_][\w.\-]*`?)")
WORDS = {"and", "or", "not", "true", "false"}


@dataclass
class Rule:
    """A compiled rule: expression text, quantile thresholds and lagged columns it needs, its terms."""

    sql: str
    quantiles: set = field(default_factory=set)
    lags: set = field(default_factory=set)
    terms: list = field(default_factory=list)


def quantile_column(col: str, q: float) -> str:
    return f"_q_{col}_{q:g}"


def resolve_name(name: str, columns: list[str], registry: Registry = REGISTRY) -> str:
    """Bare bar column first, then a feature's ``value`` output or an explicit ``FEATURE.output``."""
    if name in columns:
        return name
    feature_id, _, output = name.partition(".")
    return resolve(columns, feature_id, output or "value", registry)


def compile_rule(text: str | None, columns: list[str], registry: Registry = REGISTRY) -> Rule:
    """Rewrite a rule; an unknown name is an error here, before any job starts.  Empty text is false."""
    rule = Rule("")
    if text is None or text.strip().lower() in ("", "false"):
        rule.sql = "false"
        return rule

    def term(m: re.Match) -> str:
        left, op, right = m.group(1), m.group(2), m.group(3).strip("`")
        col = resolve_name(left, columns, registry)
        rule.terms.append((col, op, right))
        a, lagged_b = f"`{col}`", None
        if right.startswith("[q"):
            q = float(right[2:-1])
            rule.quantiles.add((col, q))
            b = f"`{quantile_column(col, q)}`"
        elif re.match(r"-?[0-9.]", right):
            b = f"{float(right)!r}D"
        else:
            other = resolve_name(right, columns, registry)
            b, lagged_b = f"`{other}`", f"`_lag_{other}`"
            if op.startswith("cross"):
                rule.lags.add(other)
        if op.startswith("cross"):
            rule.lags.add(col)
            before, now = ("<=", ">") if op == "cross_up" else (">=", "<")
            return f"coalesce(`_lag_{col}` {before} {lagged_b or b} AND {a} {now} {b}, false)"
        if a != b:
            return f"coalesce({a} {op} {b}, {'true' if op == '!=' else 'false'})"
        return f"coalesce({a} {op} {b}, false)"

    out, at = [], 0
    for m in TERM.finditer(text):
        if m.group(1).lower() in WORDS:
            raise ValueError(f"cannot read rule near {text[at:]!r}")
        out += [text[at:m.start()], term(m)]
        at = m.end()
    rest = out + [text[at:]]
    for piece in rest[::2]:
        unknown = [w for w in re.findall(r"[A-Za-z_]\w*", piece) if w.lower() not in WORDS]
        if unknown:
            raise ValueError(f"unknown words in rule: {unknown}")
    rule.sql = "".join(rest)
    return rule


def condition(rule: Rule) -> Column:
    return F.expr(rule.sql)


def add_lags(df: DataFrame, cols: set, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Previous value of each column as ``_lag_col``, group by group; the first bar of a key has none."""
    from tickloom.operators.context import with_columns_on

    if not cols:
        return df
    return with_columns_on(df, lambda s: {f"_lag_{c}": s.lag(c) for c in sorted(cols)}, name="lag", keys=keys)


def add_quantiles(df: DataFrame, pairs: set, keys: list[str]) -> DataFrame:
    """Quantile thresholds of the evaluated frame, one column per (column, q), from one aggregation."""
    if not pairs:
        return df
    df = materialize(df)
    q = exact_quantiles(df, keys, sorted(pairs))
    wide = q.groupBy(*keys).agg(*[
        F.max(F.when((F.col("col") == c) & (F.col("q") == x), F.col("value"))).alias(quantile_column(c, x)) for c, x in sorted(pairs)])
    return df.join(wide, keys)


def evaluate_rules(df: DataFrame, rules: dict[str, str], keys: list[str] | None = None, registry: Registry = REGISTRY) -> DataFrame:
    """Frame plus one boolean column per rule; quantiles are taken per ``keys`` (default: symbol)."""
    keys = keys or ["symbol"]
    compiled = {n: compile_rule(t, df.columns, registry) for n, t in rules.items()}
    base = df.columns
    out = add_lags(df, set().union(*[r.lags for r in compiled.values()]))
    out = add_quantiles(out, set().union(*[r.quantiles for r in compiled.values()]), keys)
    return out.select(*base, *[condition(r).alias(n) for n, r in compiled.items()])


def rule_complexity(conditions: DataFrame) -> DataFrame:
    """Complexity per policy from exploded condition rows (policy_id, tree, feature, depth, n_logic per tree)."""
    per_tree = conditions.groupBy("policy_id", "tree").agg(
        F.countDistinct("feature").alias("features"), F.count(F.lit(1)).alias("compares"), F.max("n_logic").alias("logic"), F.max("depth").alias("depth"))
    return per_tree.groupBy("policy_id").agg(F.sum(
        1.0 * F.col("features") + 0.5 * F.col("compares") + 0.3 * F.col("logic") + 0.2 * F.col("depth")).alias("complexity"))


def text_complexity(text: str | None) -> float:
    """Complexity of an AND rule: its terms hang below one node; a single term has depth 1."""
    if text is None or text.strip().lower() in ("", "false"):
        return 0.0
    terms = [m.group(1) for m in TERM.finditer(text)]
    if not terms:
        terms = ["TRUE"]
    n = len(terms)
    return 1.0 * len(set(terms)) + 0.5 * n + 0.3 * (n if n > 1 else 0) + 0.2 * (2 if n > 1 else 1)


def coverage(references: DataFrame, columns: DataFrame) -> DataFrame:
    """Match counts of feature references: ``references(policy_id, feature_key)`` against ``columns(column_name)``.

    direct = equal name or the feature's value column, ambiguous = several columns with the prefix,
    fuzzy = exactly one, unmatched = none.
    """
    cols = columns.select("column_name", F.split("column_name", "__")[0].alias("feature_key"))
    by_feature = cols.groupBy("feature_key").agg(F.count(F.lit(1)).alias("n_prefix"))
    exact = columns.select(F.col("column_name").alias("feature_key"), F.lit(1).alias("is_column"))
    j = references.join(by_feature, "feature_key", "left").join(exact, "feature_key", "left")
    kind = (F.when(F.col("is_column") == 1, "direct").when(F.col("n_prefix") == 1, "fuzzy").when(F.col("n_prefix") > 1, "ambiguous").otherwise("unmatched"))
    j = j.withColumn("kind", kind)
    count = lambda k: F.count_if(F.col("kind") == k)
    return j.groupBy("policy_id").agg(
        count("direct").alias("direct"), count("fuzzy").alias("fuzzy"), count("ambiguous").alias("ambiguous"), count("unmatched").alias("unmatched"),
        F.try_divide((count("direct") + count("fuzzy")).cast("double"), F.count(F.lit(1)).cast("double")).alias("match_rate"))


HOLD_COLS = ("hold_min", "hold_max")


def hold_bounds(df: DataFrame, stage_id: int, short: str = "hold_short", long: str = "hold_long") -> DataFrame:
    """Minimum and maximum hold by bucket; short wins over long."""
    s0, s1, m0, m1, l0, l1 = S.HOLD_BUCKETS[stage_id]
    pick = lambda s, l, m: F.when(F.col(short), s).when(F.col(long), l).otherwise(m).cast("int")
    return df.withColumns({"hold_min": pick(s0, l0, m0), "hold_max": pick(max(s0, s1), max(l0, l1), max(m0, m1))})


def act_timing(df: DataFrame, keys: list[str], position: Column, timing: str = "timing", entry: str = "entry", exit_: str = "exit") -> DataFrame:
    """``act`` mask per evaluated frame: always-true timing becomes every 4th bar, never-true falls back to any signal.

    The frame statistics come from an aggregation that is joined back, not from a whole-frame window.
    """
    stats = df.groupBy(*keys).agg(F.bool_and(timing).alias("_all"), F.bool_or(timing).alias("_any"))
    act = F.when(F.col("_all"), position % S.ACT_STRIDE == 0).when(~F.col("_any"), F.col(entry) | F.col(exit_)).otherwise(F.col(timing))
    return df.join(stats, keys).withColumn("act", act).drop("_all", "_any")


def policy_signals(frame: DataFrame, policies: list[dict], stage_id: int = 1, keys: tuple[str, ...] = ("symbol",),
                   position: Column | None = None, keep: tuple[str, ...] = ("close",), timing: bool = True,
                   registry: Registry = REGISTRY) -> DataFrame:
    """Long signals of all policies over a feature frame (before the state gate).

    One projection evaluates the rules of every policy; quantiles and the act mask are per ``keys``.
    """
    position = F.col("bar_idx") if position is None else position
    names = ("entry", "exit", "timing", "hold_short", "hold_long")
    compiled = {}
    for p in policies:
        rules = dict(p["rules"])
        rules["timing"] = rules.get("timing") or "true"
        rules["entry"] = rules.get("entry") or "true"
        compiled[p["policy_id"]] = {n: compile_rule(rules.get(n), frame.columns, registry) for n in names}
    every = [r for rs in compiled.values() for r in rs.values()]
    out = add_lags(frame, set().union(*[r.lags for r in every]), tuple(keys))
    out = add_quantiles(out, set().union(*[r.quantiles for r in every]), list(keys))
    rows = F.array(*[F.struct(F.lit(pid).alias("policy_id"), *[condition(rs[n]).alias(n) for n in names]) for pid, rs in compiled.items()])
    cols = [*keys, "bar_idx", *[k for k in keep if k not in keys]]
    long = out.select(*cols, position.alias("_pos"), F.explode(rows).alias("_r")).select(*cols, "_pos", "_r.*")
    if timing:
        long = act_timing(long, ["policy_id", *keys], F.col("_pos"))
        long = long.withColumns({"entry": F.col("entry") & F.col("act"), "exit": F.col("exit") & F.col("act")})
    return hold_bounds(long.drop("_pos"), stage_id)
