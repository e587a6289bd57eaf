"""SPARQL algebra to DataFrames.

A solution is a row with a struct column (t, v, dt, lang) for each variable; null means unbound.  A relation also knows which variables are always bound:
those are joined by plain equality, so Catalyst plans hash or sort-merge joins; others by compatibility.  Groups of patterns become joins in the order in which they
share variables, and constants become filters on the triple table that reach its scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import MappedTables, NUMERIC, XSD
from .fixpoint import closure
from .sparql_parser import SparqlError, parse

KIND = "struct<t:int,v:string,dt:string,lang:string>"
#: Numeric types from the narrowest to the widest; all other numeric types are kinds of integer.
WIDTHS = ["integer", "decimal", "float", "double"]
#: Rows up to which SERVICE <...broadcastJoin> sends its side to all tasks.
BROADCAST_ROWS = 100_000
#: Shared variables that may be unbound, up to which an optional part is split by which of them are.
SPLIT = 2
MOMENT = r"^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?(Z|[+-]\d\d:\d\d)?$"


def term(t, v, dt=None, lang=None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(t).cast("int").alias("t"), lit(v).cast("string").alias("v"), lit(dt).cast("string").alias("dt"), lit(lang).cast("string").alias("lang"))


@dataclass
class Relation:
    df: DataFrame
    vars: list[str]
    bound: set[str]


@dataclass
class Value:
    """An expression's result: a term column, or a plain number, string or boolean (kind), which is how built-in functions want it."""

    kind: str
    col: Column
    dt: str = ""

    def term(self) -> Column:
        if self.kind == "term":
            return self.col
        if self.kind == "num":
            text = F.when(self.col == F.floor(self.col), self.col.cast("decimal(38,0)").cast("string")).otherwise(self.col.cast("string"))
            made = term(2, text, self.dt or XSD + "decimal")
        elif self.kind == "bool":
            made = term(2, self.col.cast("string"), XSD + "boolean")
        else:
            made = term(2, self.col, XSD + "string")
        return F.when(self.col.isNotNull(), made)

    def num(self) -> Column:
        if self.kind == "num":
            return self.col
        if self.kind == "term":
            return F.when(self.col["dt"].isin(*NUMERIC), self.col["v"].try_cast("double"))
        return self.col.try_cast("double")

    def width(self) -> Column:
        """The place of a number's type in WIDTHS."""
        if self.kind != "term":
            return F.lit(WIDTHS.index(self.dt[len(XSD) :]) if self.dt[len(XSD) :] in WIDTHS else 0)
        dt = self.col["dt"]
        return F.when(dt == XSD + "decimal", 1).when(dt == XSD + "float", 2).when(dt == XSD + "double", 3).otherwise(0)

    def str(self) -> Column:
        return self.col["v"] if self.kind == "term" else self.term()["v"] if self.kind == "num" else self.col.cast("string")

    def bool(self) -> Column:
        if self.kind == "bool":
            return self.col
        if self.kind == "num":
            return self.col != 0
        if self.kind == "str":
            return self.col != ""
        number = self.num()
        return F.when(self.col["dt"] == XSD + "boolean", self.col["v"].isin("true", "1")).when(number.isNotNull(), number != 0).when((self.col["t"] == 2) & (self.col["dt"].isNull() | (self.col["dt"] == XSD + "string")), self.col["v"] != "")


class Compiler:
    def __init__(self, triples: DataFrame | MappedTables):
        self.mapped = triples if hasattr(triples, "tables_of") else None
        base = triples.frame() if self.mapped else triples
        self.spark = base.sparkSession
        self.triples = base if "g" in base.columns else base.withColumn("g", F.lit(None).cast("string"))
        self.count = 0
        self.named: list[str] | None = None
        self.start: Relation | None = None
        self.default = self.triples.where("g is null")

    def dataset(self, graphs: list[str], named: list[str]) -> None:
        """FROM and FROM NAMED: the default graph is the merge of the first, and GRAPH sees the second alone."""
        if graphs or named:
            self.mapped = None
            self.default = self.triples.where(F.col("g").isin(*graphs)).withColumn("g", F.lit(None).cast("string")).distinct() if graphs else self.triples.where(F.lit(False))
            self.named = named

    def graph_triples(self, graph, p) -> DataFrame:
        """The triples that a pattern in a graph (None: the default one) reads; of mapped tables, those of the predicate alone."""
        if graph is None:
            return self.mapped.frame(p[2] if p[0] == "term" else None).withColumn("g", F.lit(None).cast("string")) if self.mapped else self.default
        t = self.triples.where("g is not null")
        if self.named is not None:
            t = t.where(F.col("g").isin(*self.named))
        return t if graph[0] == "var" else t.where(F.col("g") == graph[2])

    def name(self, stem: str) -> str:
        self.count += 1
        return f"_{stem}{self.count}"

    # -- patterns
    def pattern(self, triple, graph) -> Relation:
        s, p, o = triple
        t = self.graph_triples(graph, p)
        if p[0] not in ("var", "term"):
            if graph is not None and graph[0] == "var":
                raise SparqlError("a path of this kind needs a named graph that is given")
            src = self.path(p, t).select(F.col("a").alias("s"), F.col("b").alias("o"))
            columns = {"s": F.col("s"), "o": F.col("o")}
        else:
            src = t
            kind = F.when(F.col("s").startswith("_:"), 0).otherwise(1)
            columns = {"s": term(kind, F.col("s")), "p": term(1, F.col("p")), "o": term(F.col("t"), F.col("o"), F.col("dt"), F.col("lang"))}
        taken: dict[str, Column] = {}
        for place, node in (("s", s), ("p", p), ("o", o)):
            if place not in columns:
                continue
            col = columns[place]
            if node[0] == "var":
                if node[1] in taken:
                    src = src.where(taken[node[1]] == col)
                else:
                    taken[node[1]] = col
            elif p[0] not in ("var", "term"):
                src = src.where((col["v"] == node[2]) & (col["t"] == node[1]))
            else:
                src = src.where(F.col(place) == node[2])
                if place == "o":
                    src = src.where(F.col("t") == node[1])
                    if node[1] == 2:
                        src = src.where(F.col("lang") == node[4] if node[4] else F.col("dt") == node[3])
        if graph is not None and graph[0] == "var":
            col = term(1, F.col("g"))
            if graph[1] in taken:
                src = src.where(taken[graph[1]] == col)
            else:
                taken[graph[1]] = col
        return Relation(src.select(*(c.alias(v) for v, c in taken.items())) if taken else src.select(F.lit(1).alias("_one")), [*taken], {*taken})

    def path(self, p, t: DataFrame) -> DataFrame:
        """Pairs of terms (a, b) that a path connects."""
        kind = F.when(F.col("s").startswith("_:"), 0).otherwise(1)
        pairs = lambda df: df.select(term(kind, F.col("s")).alias("a"), term(F.col("t"), F.col("o"), F.col("dt"), F.col("lang")).alias("b"))
        if p[0] == "term":
            return pairs(t.where(F.col("p") == p[2]))
        if p[0] == "inv":
            return self.path(p[1], t).select(F.col("b").alias("a"), F.col("a").alias("b"))
        if p[0] == "alt":
            return reduce(DataFrame.union, [self.path(x, t) for x in p[1]])
        if p[0] == "seq":
            steps = [self.path(x, t) for x in p[1]]
            return reduce(lambda x, y: x.withColumnRenamed("b", "m").join(y.select(F.col("a").alias("m"), "b"), "m").select("a", "b"), steps)
        if p[0] == "not":
            out = pairs(t.where(~F.col("p").isin(*p[1]))) if p[1] or not p[2] else None
            back = pairs(t.where(~F.col("p").isin(*p[2]))).select(F.col("b").alias("a"), F.col("a").alias("b")) if p[2] else None
            return out.union(back) if out is not None and back is not None else out if out is not None else back
        nodes = pairs(t).select(F.explode(F.array("a", "b")).alias("a")).distinct().select("a", F.col("a").alias("b"))
        one = self.path(p[1], t)
        if p[0] == "maybe":
            return one.union(nodes).distinct()
        closed = closure(one)
        return closed if p[0] == "plus" else closed.union(nodes).distinct()

    def steps(self, triples):
        """The patterns with plain sequences and inverses of predicates taken apart into patterns of their own."""
        for s, p, o in triples:
            if p[0] == "seq":
                nodes = [s, *(("var", "_" + self.name("s")) for _ in p[1][1:]), o]
                yield from self.steps([(a, x, b) for a, x, b in zip(nodes, p[1], nodes[1:])])
            elif p[0] == "inv":
                yield from self.steps([(o, p[1], s)])
            else:
                yield s, p, o

    def stars(self, triples) -> tuple[list[Relation], list]:
        """Over mapped tables: patterns about one subject whose predicates are columns of one table become one scan of it (of each such table, if there are
        several).  Also the patterns that are left."""
        groups: dict = {}
        for x in triples:
            tables = self.mapped.tables_of(x[1][2], x[2]) if x[1][0] == "term" else set()
            if tables:
                groups.setdefault(x[0], []).append((x, tables))
        out, done = [], set()
        for subject, found in groups.items():
            tables = set.intersection(*(t for _, t in found))
            if tables:
                patterns = [x for x, _ in found]
                out.append(self.union([self.star(subject, t, patterns) for t in sorted(tables)]))
                done |= {id(x) for x in patterns}
        return out, [x for x in triples if id(x) not in done]

    def star(self, subject, table: str, triples) -> Relation:
        df = self.mapped.rows(table)
        where = self.mapped.subject_is(table, subject[2]) if subject[0] == "term" else None
        df = df if where is None else df.where(where)
        taken = {} if subject[0] == "term" else {subject[1]: term(1, self.mapped.subject(table))}
        for _, p, o in triples:
            t, v, dt = self.mapped.value(table, p[2])
            df = df.where(v.isNotNull())
            if o[0] == "term":
                if o[1] != t or (t == 2 and (o[3] != dt or o[4])):
                    df = df.where(F.lit(False))
                else:
                    df = df.where(self.mapped.value_is(table, p[2], o[2]))
            elif o[1] in taken:
                df = df.where(taken[o[1]] == term(t, v, dt))
            else:
                taken[o[1]] = term(t, v, dt)
        return Relation(df.select(*(c.alias(v) for v, c in taken.items())) if taken else df.select(F.lit(1).alias("_one")), [*taken], {*taken})

    def bgp(self, triples, graph) -> Relation:
        triples = list(self.steps(triples))
        parts, rest = self.stars(triples) if self.mapped and graph is None else ([], triples)
        fixed = lambda x: sum(n[0] == "term" for n in x)
        todo = [*parts, *(self.pattern(x, graph) for x in sorted(rest, key=lambda x: -fixed(x)))]
        out = todo.pop(0) if todo else self.unit()
        while todo:
            k = next((k for k, x in enumerate(todo) if {*x.vars} & {*out.vars}), 0)
            out = self.join(out, todo.pop(k))
        return out

    def join(self, a: Relation, b: Relation, how: str = "inner", condition=None) -> Relation:
        shared = [v for v in a.vars if v in b.vars]
        renamed = {v: self.name("j") for v in shared}
        right = b.df.select(*(F.col(v).alias(renamed.get(v, v)) for v in b.vars)) if b.vars else b.df.select()
        left = a.df.select(*a.vars)
        tests = [left[v] == right[renamed[v]] if v in a.bound and v in b.bound else left[v].isNull() | right[renamed[v]].isNull() | (left[v] == right[renamed[v]]) for v in shared]
        if condition is not None:
            # In the condition of an optional part, a shared variable is what either side has.
            tests.append(condition(left, right, renamed))
        loose = [v for v in shared if not (v in a.bound and v in b.bound)]
        if how == "inner" and condition is None and loose:
            # Solutions that bind all shared variables meet by equality; only those that don't are compared one by one.
            whole_a, whole_b = (reduce(lambda x, y: x & y, (side[n].isNotNull() for n in names)) for side, names in ((left, shared), (right, [renamed[v] for v in shared])))
            equal = reduce(lambda x, y: x & y, (F.col(v) == F.col(renamed[v]) for v in shared))
            same = reduce(lambda x, y: x & y, (F.col(v).isNull() | F.col(renamed[v]).isNull() | (F.col(v) == F.col(renamed[v])) for v in shared))
            parts = [left.where(whole_a).join(right.where(whole_b), equal), left.where(~whole_a).join(right, same)]
            if not all(v in b.bound for v in shared):
                parts.append(left.where(whole_a).join(right.where(~whole_b), same))
            joined = reduce(DataFrame.unionByName, parts)
        elif not shared and how == "inner" and condition is None:
            joined = left.crossJoin(right)
        elif how == "left" and loose and len(loose) <= SPLIT and all(v in b.bound for v in shared):
            # Each way of being unbound meets by equality of the variables that are bound; where none is, every solution of the right side goes with it.
            parts = []
            for unbound in ({v for k, v in enumerate(loose) if way >> k & 1} for way in range(1 << len(loose))):
                some = left.where(reduce(lambda x, y: x & y, (left[v].isNull() if v in unbound else left[v].isNotNull() for v in loose)))
                tests = [some[v] == right[renamed[v]] for v in shared if v not in unbound] + ([condition(some, right, renamed)] if condition is not None else [])
                if tests:
                    parts.append(some.join(right, reduce(lambda x, y: x & y, tests), "left"))
                else:
                    parts += [some.crossJoin(right), some.join(right.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti")]
            joined = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
        else:
            joined = left.join(right, reduce(lambda x, y: x & y, tests) if tests else F.lit(True), how)
        columns = [F.coalesce(F.col(v), F.col(renamed[v])).alias(v) if v in shared and v not in a.bound else F.col(v) for v in a.vars]
        new = [v for v in b.vars if v not in shared]
        out = joined.select(*columns, *new)
        return Relation(out, [*a.vars, *new], a.bound | b.bound if how == "inner" else set(a.bound))

    def unit(self) -> Relation:
        return Relation(self.spark.range(1).select(), [], set())

    def service(self, iri: str, side: Relation) -> Relation:
        """Hints in the form of services: keep the side's solutions, or send them to all tasks while they are few."""
        hint = iri.rsplit(":", 1)[-1].rsplit("/", 1)[-1].rsplit("#", 1)[-1]
        if hint == "cache":
            return Relation(side.df.persist(StorageLevel.MEMORY_AND_DISK), side.vars, side.bound)
        if hint == "broadcastJoin":
            few = side.df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
            return Relation(F.broadcast(side.df), side.vars, side.bound) if few else side
        raise SparqlError(f"no service {iri}")

    def group(self, node, graph=None, start: Relation | None = None) -> Relation:
        """start: the solutions that LATERAL hands in."""
        if start is None:
            start, self.start = self.start, None  # what the outermost group begins with
        out, filters = start, []
        for part in node[1]:
            kind = part[0]
            if kind == "filter":
                filters.append(part[1])
                continue
            if kind == "optional":
                inner = [x for x in part[1][1] if x[0] != "filter"]
                tests = [x[1] for x in part[1][1] if x[0] == "filter"]
                side = self.group(("group", inner), graph)
                base = out or self.unit()
                condition = None
                if tests:
                    def condition(left, right, renamed, base=base, side=side, tests=tests):
                        lookup = {v: left[v] for v in base.vars} | {v: right[renamed.get(v, v)] if v not in base.vars else F.coalesce(left[v], right[renamed[v]]) for v in side.vars}
                        return reduce(lambda x, y: x & y, (F.coalesce(self.value(e, lookup).bool(), F.lit(False)) for e in tests))
                out = self.join(base, side, "left", condition)
                continue
            if kind == "minus":
                out = self.anti(out or self.unit(), self.group(part[1], graph))
                continue
            if kind == "bind":
                base = out or self.unit()
                made = self.value(part[2], self.lookup(base)).term()
                out = Relation(base.df.select(*base.vars, made.alias(part[1])), [*base.vars, part[1]], set(base.bound))
                continue
            if kind == "lateral":
                out = self.group(part[1], graph, out or self.unit())
                continue
            side = {
                "service": lambda: self.service(part[1][2], self.group(part[2], graph)),
                "bgp": lambda: self.bgp(part[1], graph),
                "union": lambda: self.union([self.group(x, graph) for x in part[1]]),
                "sub_group": lambda: self.group(part[1], graph),
                "values": lambda: self.values(part[1], part[2]),
                "graph": lambda: self.group(part[2], part[1]),
                "sub": lambda: self.select(part[1], graph),
            }[kind]()
            out = side if out is None else self.join(out, side)
        out = out or self.unit()
        for e in filters:
            out = self.filter(out, e, graph)
        return out

    def filter(self, rel: Relation, e, graph) -> Relation:
        if e[0] == "and":
            return self.filter(self.filter(rel, e[1], graph), e[2], graph)
        negated = False
        while e[0] == "not" and e[1][0] == "exists":
            e, negated = e[1], not negated
        if e[0] == "exists":
            side = self.group(e[1], graph)
            shared = [v for v in rel.vars if v in side.vars]
            right = side.df.select(*(F.col(v).alias(f"_x{v}") for v in shared)).distinct()
            tests = [rel.df[v] == right[f"_x{v}"] if v in rel.bound and v in side.bound else rel.df[v].isNull() | right[f"_x{v}"].isNull() | (rel.df[v] == right[f"_x{v}"]) for v in shared]
            how = "left_anti" if e[2] != negated else "left_semi"
            return Relation(rel.df.join(right, reduce(lambda x, y: x & y, tests) if tests else F.lit(True), how), rel.vars, rel.bound)
        rel, e = self.mark(rel, e, graph)
        keep = self.value(e, self.lookup(rel)).bool()
        bound = rel.bound | {x[2][0][1] for x in [e] if x[0] == "call" and x[1] == "BOUND"}
        return Relation(rel.df.where(keep), rel.vars, bound)

    def mark(self, rel: Relation, e, graph):
        """rel with a column for each EXISTS inside an expression, and the expression with those columns in their place."""
        if isinstance(e, list):
            out = []
            for x in e:
                rel, x = self.mark(rel, x, graph)
                out.append(x)
            return rel, out
        if not isinstance(e, tuple) or e[0] in ("term", "var"):
            return rel, e
        if e[0] != "exists":
            out = []
            for x in e:
                rel, x = self.mark(rel, x, graph) if isinstance(x, (tuple, list)) else (rel, x)
                out.append(x)
            return rel, tuple(out)
        side = self.group(e[1], graph)
        shared, flag = [v for v in rel.vars if v in side.vars], self.name("e")
        right = side.df.select(*(F.col(v).alias(f"{flag}{k}") for k, v in enumerate(shared)), F.lit(True).alias(flag)).distinct()
        tight = all(v in rel.bound and v in side.bound for v in shared)
        left = rel.df if tight else rel.df.withColumn(f"{flag}_id", F.monotonically_increasing_id())
        tests = [F.col(v) == F.col(f"{flag}{k}") if tight else F.col(v).isNull() | F.col(f"{flag}{k}").isNull() | (F.col(v) == F.col(f"{flag}{k}")) for k, v in enumerate(shared)]
        joined = left.join(right, reduce(lambda x, y: x & y, tests) if tests else F.lit(True), "left")
        joined = joined if tight else joined.dropDuplicates([f"{flag}_id"])
        found = F.coalesce(F.col(flag), F.lit(False))
        df = joined.select(*rel.df.columns, (~found if e[2] else found).alias(f"{flag}_found"))
        return Relation(df, rel.vars, rel.bound), ("flag", f"{flag}_found")

    def anti(self, a: Relation, b: Relation) -> Relation:
        shared = [v for v in a.vars if v in b.vars]
        if not shared:
            return a
        right = b.df.select(*(F.col(v).alias(f"_m{v}") for v in shared)).distinct()
        same = reduce(lambda x, y: x & y, (a.df[v] == right[f"_m{v}"] if v in a.bound and v in b.bound else a.df[v].isNull() | right[f"_m{v}"].isNull() | (a.df[v] == right[f"_m{v}"]) for v in shared))
        if not all(v in a.bound and v in b.bound for v in shared):
            same = same & reduce(lambda x, y: x | y, (a.df[v].isNotNull() & right[f"_m{v}"].isNotNull() for v in shared))
        return Relation(a.df.join(right, same, "left_anti"), a.vars, a.bound)

    def union(self, sides: list[Relation]) -> Relation:
        names = list(dict.fromkeys(v for r in sides for v in r.vars))
        dfs = [r.df.select(*(F.col(v) if v in r.vars else F.lit(None).cast(KIND).alias(v) for v in names)) for r in sides]
        if len(sides) == 1:
            return sides[0]
        return Relation(reduce(DataFrame.union, dfs), names, set.intersection(*(r.bound for r in sides)))

    def values(self, names, rows) -> Relation:
        data = [tuple(None if x is None else (x[1], x[2], x[3], x[4]) for x in row) for row in rows]
        df = self.spark.createDataFrame(data, ", ".join(f"`{n}` {KIND}" for n in names))
        return Relation(df, names, {n for k, n in enumerate(names) if all(r[k] is not None for r in rows)})

    # -- solution modifiers
    def select(self, q, graph=None) -> Relation:
        _, items, distinct, where, group, having, order, limit, offset = q
        rel = self.group(where, graph)
        if items is None:
            items = [(v, None) for v in rel.vars if not v.startswith("__")]
        aggregates: list = []

        def lift(e):
            """The expression with its aggregates replaced by variables."""
            if not isinstance(e, tuple):
                return [lift(x) for x in e] if isinstance(e, list) else e
            if e[0] == "agg":
                aggregates.append((self.name("a"), e))
                return ("var", aggregates[-1][0])
            return e if e[0] in ("term", "var", "exists") else tuple(lift(x) for x in e)

        lifted = [(v, None if e is None else lift(e)) for v, e in items]
        having, order = [lift(e) for e in having], [(lift(e), down) for e, down in order]
        if group or aggregates:
            look = self.lookup(rel)
            keys = [self.value(e, look).term().alias(v) for v, e in group]
            made = [self.aggregate(e, look).alias(v) for v, e in aggregates]
            df = rel.df.groupBy(*keys).agg(*made) if made else rel.df.select(*keys).distinct()
            rel = Relation(df, [v for v, _ in group] + [v for v, _ in aggregates], {v for v, e in group if e[0] == "var" and e[1] in rel.bound})
        for e in having:
            rel = self.filter(rel, e, graph)
        for v, e in lifted:
            if e is not None:
                made = self.value(e, self.lookup(rel)).term()
                rel = Relation(rel.df.select(*(x for x in rel.vars if x != v), made.alias(v)), [x for x in rel.vars if x != v] + [v], rel.bound - {v})
        names = [v for v, _ in items]
        have = {*rel.vars}
        extra = [] if distinct else [v for v in rel.vars if v not in names]
        df = rel.df.select(*(F.col(v) if v in have else F.lit(None).cast(KIND).alias(v) for v in names), *extra)
        if distinct:
            df = df.distinct()
        if order:
            look = {v: F.col(v) for v in [*names, *extra]}
            keys = []
            for e, down in order:
                value = self.value(e, look)
                for c in (value.num(), value.str()):
                    keys.append(c.desc_nulls_last() if down else c.asc_nulls_first())
            df = df.orderBy(*keys)
        if offset:
            df = df.offset(offset)
        if limit is not None:
            df = df.limit(limit)
        return Relation(df.select(*names), names, rel.bound & {*names})

    def aggregate(self, e, look) -> Column:
        _, name, distinct, inner, separator = e
        if name == "COUNT":
            if inner is None:
                col = F.countDistinct(F.struct(*look.values())) if distinct else F.count("*")
            else:
                t = self.value(inner, look).term()
                # A struct of nulls would count; the value and kind decide.
                col = F.countDistinct(F.when(t.isNotNull(), t)) if distinct else F.count(t)
            return Value("num", col, XSD + "integer").term()
        value = self.value(inner, look)
        if name in ("SUM", "AVG"):
            n = value.num()
            # Decimals add up exactly; the result has the widest type of the inputs, an average is a decimal at least.
            exact = n.cast("decimal(38,6)")
            wide = F.coalesce(F.max(F.when(n.isNotNull(), value.width())), F.lit(0))
            total, size = (F.sum_distinct(n), F.count_distinct(n)) if distinct else (F.sum(n), F.count(n))
            total_exact = F.sum_distinct(exact) if distinct else F.sum(exact)
            if name == "AVG":
                total, total_exact, wide = F.try_divide(total, size), F.try_divide(total_exact.cast("decimal(38,12)"), size), F.greatest(wide, F.lit(1))
            plain = F.regexp_replace(F.regexp_replace(F.coalesce(total_exact, F.lit(0)).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
            text = F.when(wide < 2, F.coalesce(plain, total.cast("string"))).otherwise(F.coalesce(total, F.lit(0.0)).cast("string"))
            return term(2, text, F.element_at(F.array(*(F.lit(XSD + w) for w in WIDTHS)), wide + 1))
        t = value.term()
        if name in ("MIN", "MAX"):
            key = F.struct(value.num().alias("n"), value.str().alias("x"))
            return (F.min_by if name == "MIN" else F.max_by)(t, key)
        if name == "SAMPLE":
            return F.first(t, ignorenulls=True)
        return term(2, F.array_join(F.sort_array((F.collect_set if distinct else F.collect_list)(value.str())), separator), XSD + "string")

    # -- expressions
    @staticmethod
    def lookup(rel: Relation) -> dict[str, Column]:
        return {v: rel.df[v] for v in rel.vars}

    def value(self, e, look) -> Value:
        kind = e[0]
        if kind == "var":
            return Value("term", look[e[1]] if e[1] in look else F.lit(None).cast(KIND))
        if kind == "term":
            if e[1] == 2 and e[3] in NUMERIC:
                return Value("num", F.lit(float(e[2])), e[3])
            if e[1] == 2 and e[3] == XSD + "boolean":
                return Value("bool", F.lit(e[2] in ("true", "1")))
            return Value("term", term(*e[1:]))
        if kind in ("or", "and"):
            a, b = self.value(e[1], look).bool(), self.value(e[2], look).bool()
            return Value("bool", a | b if kind == "or" else a & b)
        if kind == "not":
            return Value("bool", ~self.value(e[1], look).bool())
        if kind == "cmp":
            return Value("bool", self.compare(e[1], self.value(e[2], look), self.value(e[3], look)))
        if kind == "in":
            x = self.value(e[1], look)
            return Value("bool", reduce(lambda a, b: a | b, (self.compare("=", x, self.value(y, look)) for y in e[2]), F.lit(False)))
        if kind == "arith":
            a, b = self.value(e[2], look), self.value(e[3], look)
            x, y = a.num(), b.num()
            out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[e[1]]()
            integer = e[1] != "/" and a.dt == b.dt == XSD + "integer"
            return Value("num", out, XSD + "integer" if integer else XSD + "decimal")
        if kind == "call":
            return self.call(e[1], e[2], look)
        if kind == "flag":
            return Value("bool", F.col(e[1]))
        raise SparqlError(f"no value: {kind}")

    @staticmethod
    def compare(op: str, a: Value, b: Value) -> Column:
        test = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
        if "num" in (a.kind, b.kind):
            return test(a.num(), b.num())
        if "bool" in (a.kind, b.kind):
            return test(a.bool(), b.bool())
        if a.kind == b.kind == "term":
            by_text = test(a.col["v"], b.col["v"])
            if op in ("=", "!="):
                by_text = a.col == b.col if op == "=" else a.col != b.col
            return F.coalesce(test(a.num(), b.num()), by_text)
        return test(a.str(), b.str())

    def call(self, name: str, args, look) -> Value:
        if name == "BOUND":
            return Value("bool", self.value(args[0], look).col.isNotNull())
        v = [self.value(x, look) for x in args]
        if name == "COALESCE":
            return Value("term", F.coalesce(*(x.term() for x in v)))
        if name == "IF":
            return Value("term", F.when(v[0].bool(), v[1].term()).when(~v[0].bool(), v[2].term()))
        if name in ("STR", "UCASE", "LCASE", "STRLEN", "ENCODE_FOR_URI", "MD5", "SHA1", "SHA256", "SHA384", "SHA512"):
            s = v[0].str()
            if name == "STRLEN":
                return Value("num", F.length(s), XSD + "integer")
            made = {"STR": lambda: s, "UCASE": lambda: F.upper(s), "LCASE": lambda: F.lower(s), "ENCODE_FOR_URI": lambda: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), "MD5": lambda: F.md5(s), "SHA1": lambda: F.sha1(s)}
            return Value("str", made[name]() if name in made else F.sha2(s, int(name[3:])))
        if name in ("CONTAINS", "STRSTARTS", "STRENDS"):
            return Value("bool", getattr(F, {"CONTAINS": "contains", "STRSTARTS": "startswith", "STRENDS": "endswith"}[name])(v[0].str(), v[1].str()))
        if name in ("STRBEFORE", "STRAFTER"):
            s, mark = v[0].str(), v[1].str()
            at = F.locate(args[1][2], s) if args[1][0] == "term" else F.position(mark, s)
            return Value("str", F.when(at == 0, "").otherwise(F.substr(s, F.lit(1), at - 1) if name == "STRBEFORE" else F.substr(s, at + F.length(mark))))
        if name == "SUBSTR":
            return Value("str", F.substr(v[0].str(), v[1].num().cast("int"), *([v[2].num().cast("int")] if len(v) > 2 else [])))
        if name == "CONCAT":
            return Value("str", F.concat(*(x.str() for x in v)))
        if name in ("REGEX", "REPLACE"):
            flags = args[2 + (name == "REPLACE")][2] if len(args) > 2 + (name == "REPLACE") else ""
            pattern = F.concat(F.lit(f"(?{flags})" if flags else ""), v[1].str())
            return Value("bool", F.rlike(v[0].str(), pattern)) if name == "REGEX" else Value("str", F.regexp_replace(v[0].str(), pattern, v[2].str()))
        if name in ("ABS", "CEIL", "FLOOR", "ROUND"):
            n = v[0].num()
            made = {"ABS": lambda: F.abs(n), "CEIL": lambda: F.ceil(n), "FLOOR": lambda: F.floor(n), "ROUND": lambda: F.floor(n + 0.5)}[name]()
            return Value("num", made, v[0].dt or XSD + "decimal")
        if name in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS", "TZ", "TIMEZONE"):
            part = F.regexp_extract(v[0].str(), MOMENT, {"YEAR": 1, "MONTH": 2, "DAY": 3, "HOURS": 4, "MINUTES": 5, "SECONDS": 6}.get(name, 7))
            known = F.when(v[0].str().rlike(MOMENT), part)
            if name == "TZ":
                return Value("str", known)
            if name == "TIMEZONE":
                hours, minutes = F.substring(part, 2, 2).cast("int"), F.substring(part, 5, 2).cast("int")
                span = F.concat(F.when((F.substring(part, 1, 1) == "-") & (hours + minutes > 0), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""), F.when(hours + minutes == 0, "0S").otherwise(""))
                text = F.when(part == "Z", F.lit("PT0S")).when(part != "", span)
                return Value("term", F.when(text.isNotNull(), term(2, text, XSD + "dayTimeDuration")))
            return Value("num", F.when(known != "", known).cast("double"), XSD + ("decimal" if name == "SECONDS" else "integer"))
        if name == "NOW":
            return Value("term", term(2, F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), XSD + "dateTime"))
        if name == "RAND":
            return Value("num", F.rand(), XSD + "double")
        if name in ("UUID", "STRUUID"):
            return Value("term", term(1, F.concat(F.lit("urn:uuid:"), F.uuid()))) if name == "UUID" else Value("str", F.uuid())
        if name == "BNODE":
            return Value("term", term(0, F.concat(F.lit("_:"), F.concat(F.lit("b"), F.md5(v[0].str())) if v else F.replace(F.uuid(), F.lit("-")))))
        if name in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL"):
            return Value("bool", v[0].term()["t"] == {"ISBLANK": 0, "ISLITERAL": 2}.get(name, 1))
        if name == "ISNUMERIC":
            return Value("bool", F.when(v[0].term().isNotNull(), v[0].num().isNotNull()))
        if name == "LANG":
            t = v[0].term()
            return Value("str", F.when(t["t"] == 2, F.coalesce(t["lang"], F.lit(""))))
        if name == "LANGMATCHES":
            tag, wanted = F.lower(v[0].str()), F.lower(v[1].str())
            return Value("bool", F.when(wanted == "*", tag != "").otherwise((tag == wanted) | F.startswith(tag, F.concat(wanted, F.lit("-")))))
        if name == "DATATYPE":
            t = v[0].term()
            return Value("term", F.when(t["t"] == 2, term(1, F.coalesce(t["dt"], F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")))))
        if name in ("IRI", "URI"):
            return Value("term", F.when(v[0].str().isNotNull(), term(1, v[0].str())))
        if name == "STRDT":
            return Value("term", F.when(v[0].str().isNotNull(), term(2, v[0].str(), v[1].str())))
        if name == "STRLANG":
            return Value("term", F.when(v[0].str().isNotNull(), term(2, v[0].str(), None, F.lower(v[1].str()))))
        if name == "SAMETERM":
            return Value("bool", v[0].term() == v[1].term())
        if name.startswith(XSD):
            if name in NUMERIC:
                return Value("num", v[0].str().try_cast("double"), name)
            return Value("bool", v[0].str().try_cast("boolean")) if name == XSD + "boolean" else Value("term", F.when(v[0].str().isNotNull(), term(2, v[0].str(), name)))
        raise SparqlError(f"unknown function {name}")

    # -- query forms
    def run(self, text: str) -> DataFrame:
        q = parse(text)
        if q[0] == "from":
            self.dataset(q[1], q[2])
            q = q[3]
        if q[0] == "select":
            return self.select(q).df
        if q[0] == "ask":
            return self.group(q[1]).df.limit(1).agg((F.count("*") > 0).alias("answer"))
        if q[0] == "construct":
            return self.construct(q)
        rel = self.group(q[2])
        ids = [rel.df.select(F.col(n[1])["v"].alias("id")) if n[0] == "var" else self.spark.createDataFrame([(n[2],)], "id string") for n in q[1]]
        wanted = reduce(DataFrame.union, ids).distinct()
        return self.default.drop("g").join(wanted, F.col("s") == F.col("id"), "left_semi")

    def construct(self, q) -> DataFrame:
        """The triples of a template; quads, with their graph in g, if the template names graphs.  A blank node of the template is one of its own in each solution."""
        rel = self.select(q[2])
        key = F.md5(F.concat_ws("|", *(F.coalesce(F.to_json(F.col(v)), F.lit("")) for v in rel.vars))) if rel.vars else F.lit("")
        made, quads = [], any(len(x) > 3 for x in q[1])
        for s, p, o, *g in q[1]:
            def col(n):
                if n[0] == "term":
                    return term(*n[1:])
                if n[1] in rel.vars:
                    return F.col(n[1])
                return term(0, F.concat(F.lit(f"_:{n[1].lstrip('.')}"), key)) if n[1].startswith("__") else F.lit(None).cast(KIND)

            made.append(F.struct(col(s).alias("s"), col(p).alias("p"), col(o).alias("o"), (col(g[0]) if g else F.lit(None).cast(KIND)).alias("g"), F.lit(bool(g)).alias("in_graph")))
        x = F.col("x")
        ok = x["s"].isNotNull() & x["p"].isNotNull() & x["o"].isNotNull() & (x["s"]["t"] < 2) & (x["p"]["t"] == 1) & (~x["in_graph"] | F.coalesce(x["g"]["t"] == 1, F.lit(False)))
        rows = rel.df.select(F.explode(F.array(*made)).alias("x")).where(ok)
        columns = [x["s"]["v"].alias("s"), x["p"]["v"].alias("p"), x["o"]["v"].alias("o"), x["o"]["t"].alias("t"), x["o"]["dt"].alias("dt"), x["o"]["lang"].alias("lang")]
        return rows.select(*columns, *([x["g"]["v"].alias("g")] if quads else [])).distinct()


def query(triples: DataFrame | MappedTables, text: str, start: DataFrame | None = None) -> DataFrame:
    """The solutions of a SELECT query (a struct column a variable), an ASK query's answer, or the triples of CONSTRUCT and DESCRIBE.
    start: solutions that the outermost group begins with, a column of terms a variable."""
    compiler = Compiler(triples)
    if start is not None:
        compiler.start = Relation(start, start.columns, set())
    return compiler.run(text)


def plain(df: DataFrame, numbers: tuple[str, ...] = ()) -> DataFrame:
    """Solutions as strings; the named variables as numbers."""
    return df.select(*(F.col(c)["v"].try_cast("double").alias(c) if c in numbers else F.col(c)["v"].alias(c) for c in df.columns))
