"""Queries over a data lake: what a query asks of each source, in which order its stars are joined, and its answer.

The plan is for people to read and to weigh sources; Catalyst has the last word on joins when the query is run.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.mapping import MappedSources
from .sparql import query
from .sparql_parser import parse


@dataclass
class LakePlan:
    stars: dict[str, list[tuple]]
    sources: dict[str, set[str]]
    joins: list[tuple[str, str, str]]
    needed: dict[str, set[str]]
    filters: list
    group_by: list[str]
    order_by: list[tuple[str, bool]]
    limit: int | None
    distinct: bool
    order: list[str] = field(default_factory=list)


def _name(node) -> str:
    return node[1] if node[0] == "var" else node[2]


def _variables(e) -> set[str]:
    if isinstance(e, (tuple, list)):
        return {e[1]} if len(e) == 2 and e[0] == "var" else set().union(*map(_variables, e)) if e else set()
    return set()


def plan(text: str, lake: MappedSources | None = None, weights: dict[str, float] | None = None) -> LakePlan:
    """The parts of a SELECT query: stars by subject, the sources that have all of a star's predicates, join edges (an object of one star is another's subject), the
    predicates whose values are used at all, and an order of joins that begins with the star of the highest score: its source's weight, and one for each filter on it."""
    q = parse(text)
    q = q[3] if q[0] == "from" else q
    _, items, distinct, where, group, _, order, limit, _ = q
    stars: dict[str, list[tuple]] = {}
    filters = [x[1] for x in where[1] if x[0] == "filter"]
    for kind, *rest in where[1]:
        if kind == "bgp":
            for s, p, o in rest[0]:
                stars.setdefault(_name(s), []).append((p, o))
    found = {}
    for s, pairs in stars.items():
        sets = [lake.tables_of(p[2], o) for p, o in pairs if p[0] == "term"] if lake else []
        found[s] = set.intersection(*sets) if sets else set()
    joins = [(s, _name(o), p[2]) for s, pairs in stars.items() for p, o in pairs if o[0] == "var" and o[1] in stars and p[0] == "term"]
    wanted = {v for v, e in items or []} | _variables([e for _, e in items or [] if e]) | _variables(filters) | _variables([e for _, e in group]) | _variables([e for e, _ in order])
    shared = {b for _, b, _ in joins}
    needed = {s: {p[2] for p, o in pairs if p[0] == "term" and (o[0] == "term" or items is None or o[1] in wanted | shared)} for s, pairs in stars.items()}
    made = LakePlan(stars, found, joins, needed, filters, [v for v, _ in group], [(_name(e) if e[0] == "var" else "", down) for e, down in order], limit, distinct)
    made.order = reorder(made, weights or {})
    return made


def reorder(p: LakePlan, weights: dict[str, float]) -> list[str]:
    filtered = [{o[1] for _, o in pairs if o[0] == "var"} for pairs in p.stars.values()]
    score = {s: max((weights.get(x, 0.0) for x in p.sources[s]), default=0.0) + sum(bool(_variables(f) & have) for f in p.filters) + sum(o[0] == "term" for _, o in p.stars[s]) for s, have in zip(p.stars, filtered)}
    left, out = dict(score), []
    while left:
        linked = [s for s in left if any({a, b} & {s} and {a, b} & set(out) for a, b, _ in p.joins)]
        best = max(linked or left, key=lambda s: score[s])
        out.append(best)
        left.pop(best)
    return out


def read_config(text: str) -> tuple[dict[str, dict], dict[str, float]]:
    """Sources by entity (type, source, options), and weights by type of source, from a JSON configuration."""
    config = json.loads(text)
    return {s["entity"]: s for s in config.get("sources", [])}, {w["datasource"]: float(w["weight"]) for w in config.get("weights", [])}


def answer(spark: SparkSession, text: str, mapping: str, base: str = "", views: dict[str, DataFrame] | None = None) -> DataFrame:
    """The solutions of a query over mapped sources."""
    return query(MappedSources(spark, mapping, base, views), text)


def transform(column: Column, steps: list[str]) -> Column:
    """A join key made fit for another source's: toInt; scl(x) scales; skp(n) skips characters at the start, or at the end if negative; substit(a, b) and replc(a, b)
    replace a whole value and each part; prefix(x) and postfix(x)."""
    for step in steps:
        name, _, rest = step.partition("(")
        args = [a.strip() for a in rest.rstrip(")").split(",")] if rest else []
        if name == "toInt":
            column = column.cast("long")
        elif name == "scl":
            column = column.cast("double") * float(args[0])
        elif name == "skp":
            n = int(args[0])
            column = F.substring(column, n + 1, 1 << 30) if n >= 0 else F.substr(column, F.lit(1), F.greatest(F.length(column) + n, F.lit(0)))
        elif name == "substit":
            column = F.when(column == args[0], args[1]).otherwise(column)
        elif name == "replc":
            column = F.replace(column, F.lit(args[0]), F.lit(args[1]))
        elif name in ("prefix", "postfix"):
            column = F.concat(*([F.lit(args[0]), column.cast("string")] if name == "prefix" else [column.cast("string"), F.lit(args[0])]))
        else:
            raise ValueError(f"no transformation {step}")
    return column


def wide_tables(t: DataFrame, type_predicate: str) -> dict[str, DataFrame]:
    """A table a class: one row a subject, a column a predicate (the values joined by commas), and a flag for each further class.  A subject's table is that of its last class by name."""
    classes = t.where(F.col("p") == type_predicate).groupBy("s").agg(F.sort_array(F.collect_set("o")).alias("all"))
    last = classes.select("s", F.element_at("all", -1).alias("class"), "all")
    names = [r["class"] for r in last.select("class").distinct().orderBy("class").collect()]  # classes of an ontology, not rows
    rows = t.where(F.col("p") != type_predicate).join(last, "s")
    out = {}
    for name in names:
        own = rows.where(F.col("class") == name)
        flags = [r["c"] for r in own.select(F.explode("all").alias("c")).distinct().where(F.col("c") != name).orderBy("c").collect()]
        local = lambda x: F.regexp_extract(x, r"([^/#:]*)$", 1)
        wide = own.withColumn("p", local(F.col("p"))).groupBy("s").pivot("p").agg(F.array_join(F.sort_array(F.collect_list("o")), ","))
        if flags:
            have = last.where(F.col("class") == name).select("s", *(F.array_contains("all", f).cast("int").alias("type_" + f.rsplit("/", 1)[-1].rsplit("#", 1)[-1].rsplit(":", 1)[-1]) for f in flags))
            wide = wide.join(have, "s")
        out[name] = wide
    return out
