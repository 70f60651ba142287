"""openCypher subset: syntax tree to a lazy DataFrame.

A variable's properties are flat columns ``var__property``, so Catalyst prunes
them and pushes predicates to the scans. Typed patterns filter edges before
they join; a pattern predicate becomes a semi or anti join; a node that nothing
looks at is never joined; bounded variable lengths unroll into joins with a
check that no relationship repeats in a clause. A variable length without an
upper bound is worked out hop by hop, each written, until nothing is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import PropertyGraph
from ..operators.traverse import written
from .parser import CypherError, Match, Path, Projection, Query, Rel, Unwind, parse

AGGREGATES = frozenset("count sum avg min max collect".split())


def _variables(e) -> set[str]:
    """Names that an expression or clause mentions."""
    if isinstance(e, tuple):
        if e and e[0] == "var":
            return {e[1]}
        if e and e[0] == "label":
            return {e[1]}
        return set().union(*map(_variables, e)) if e else set()
    if isinstance(e, list):
        return set().union(*map(_variables, e)) if e else set()
    if isinstance(e, dict):
        return _variables(list(e.values()))
    if isinstance(e, Path):
        return {n.var for n in e.nodes} | {r.var for r in e.rels} | _variables([x.props for x in (*e.nodes, *e.rels)])
    return set()


def _has_aggregate(e) -> bool:
    if isinstance(e, tuple) and e:
        return (e[0] == "call" and e[1] in AGGREGATES) or any(map(_has_aggregate, e))
    return isinstance(e, list) and any(map(_has_aggregate, e))


def _fields(e, var: str) -> set[str]:
    """Properties of a list's element that an expression reads; ``*`` stands for all."""
    if e == ("var", var):
        return {"*"}
    if isinstance(e, tuple) and e[:1] == ("prop",) and e[1] == ("var", var):
        return {e[2]}
    if isinstance(e, tuple) and e[:2] == ("call", "id") and e[3] == [("var", var)]:
        return {"id"}
    return set().union(*(_fields(x, var) for x in e)) if isinstance(e, tuple | list) and e else set()


def _path_fields(e, path: str) -> set[str]:
    """Properties of a path's nodes that an expression reads; ``*`` stands for all."""
    if e == ("var", path):
        return {"*"}
    if isinstance(e, tuple) and e[:1] == ("call",) and e[3] == [("var", path)] and e[1] in ("length", "size", "relationships", "rels"):
        return set()
    if isinstance(e, tuple) and e[:1] == ("comprehension",) and e[2][:2] == ("call", "nodes") and e[2][3] == [("var", path)]:
        return _fields([e[3], e[4]], e[1]) | _path_fields([e[3], e[4]], path)
    return set().union(*(_path_fields(x, path) for x in e)) if isinstance(e, tuple | list) and e else set()


def _mentions_pattern(e) -> bool:
    return isinstance(e, tuple | list) and (e[:1] == ("pattern",) or any(map(_mentions_pattern, e)))


def _ignores_repeats(e) -> bool:
    """Whether all aggregates of an expression are the same if rows repeat."""
    if isinstance(e, tuple) and e[:1] == ("call",) and e[1] in AGGREGATES:
        return e[1] in ("min", "max") or (bool(e[2]) and e[1] in ("count", "collect") and e[3] != [("star",)])
    return all(map(_ignores_repeats, e)) if isinstance(e, tuple | list) else True


class _Lowering:
    def __init__(self, graph: PropertyGraph, query: Query, params: dict, max_hops: int | None) -> None:
        self.g, self.query, self.params, self.max_hops = graph, query, params, max_hops
        self.df: DataFrame | None = None
        #: What a name stands for: node, rel, path or value.
        self.kinds: dict[str, str] = {}
        self.local: dict[str, Column] = {}
        self.serial = 0

    # Expressions

    def column(self, e: tuple) -> Column:
        op = e[0]
        if op == "lit":
            return F.lit(e[1])
        if op == "param":
            v = self.params[e[1]]
            return F.array(*map(F.lit, v)) if isinstance(v, list | tuple) else F.lit(v)
        if op == "var":
            return self.variable(e[1])
        if op == "label":
            return F.col(f"{e[1]}__label") == e[2]
        if op == "prop":
            return self.prop(e[1], e[2])
        if op in ("and", "or"):
            a, b = self.column(e[1]), self.column(e[2])
            return a & b if op == "and" else a | b
        if op == "xor":
            return self.column(e[1]) != self.column(e[2])
        if op == "not":
            return ~self.column(e[1])
        if op == "null":
            if e[1][0] == "var" and self.kinds.get(e[1][1]) in ("node", "rel"):
                return F.col(f"{e[1][1]}__{'id' if self.kinds[e[1][1]] == 'node' else 'edge_id'}").isNull()
            return self.column(e[1]).isNull()
        if op == "cmp":
            return self.compare(e[1], e[2], e[3])
        if op == "in":
            return F.array_contains(self.column(e[2]), self.column(e[1]))
        if op == "op":
            a, b = self.column(e[2]), self.column(e[3])
            if e[1] == "+" and any(x[0] == "lit" and isinstance(x[1], str) for x in (e[2], e[3])):
                return F.concat(a.cast("string"), b.cast("string"))
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}[e[1]]()
        if op == "list":
            return F.array(*[self.column(x) for x in e[1]])
        if op == "index":
            i = e[2]
            if i[0] == "lit":
                return F.try_element_at(self.column(e[1]), F.lit(i[1] + 1))
            return F.get(self.column(e[1]), self.column(i).cast("int"))
        if op == "case":
            out = None
            for c, v in e[1]:
                out = F.when(self.column(c), self.column(v)) if out is None else out.when(self.column(c), self.column(v))
            return out.otherwise(self.column(e[2]))
        if op == "comprehension":
            return self.comprehension(*e[1:])
        if op == "flag":
            return F.coalesce(F.col(e[1]), F.lit(False))
        if op == "call":
            return self.call(e)
        raise CypherError(f"{op} isn't allowed here")

    def variable(self, name: str) -> Column:
        if name in self.local:
            return self.local[name]
        kind = self.kinds.get(name)
        if kind == "value":
            return F.col(f"`{name}`")
        if kind == "node":
            return F.struct(*[F.col(f"{name}__{c}").alias(c) for c in self.g.node_columns])
        if kind == "rel":
            return F.struct(*[F.col(f"{name}__{c}").alias(c) for c in self.g.edge_columns])
        if kind == "rels":
            return F.col(f"{name}__rels")
        if kind == "path":
            return F.struct(F.col(f"{name}__nodes").alias("nodes"), F.col(f"{name}__rels").alias("rels"))
        raise CypherError(f"{name} isn't defined")

    def prop(self, of: tuple, key: str) -> Column:
        if of[0] == "var" and of[1] not in self.local and self.kinds.get(of[1]) in ("node", "rel"):
            cols = self.g.node_columns if self.kinds[of[1]] == "node" else self.g.edge_columns
            if key == "size" and "communitySize" in cols:
                return F.coalesce(F.col(f"{of[1]}__size"), F.col(f"{of[1]}__communitySize").cast("long"))
            if key in cols:
                return F.col(f"{of[1]}__{key}")
            return F.col(f"{of[1]}__props")[key] if "props" in cols else F.lit(None).cast("string")
        return self.column(of)[key]

    def compare(self, op: str, left: tuple, right: tuple) -> Column:
        ends = [x[1] for x in (left, right) if x[0] == "var" and x[1] not in self.local and self.kinds.get(x[1]) in ("node", "rel")]
        if len(ends) == 2 and op in ("=", "<>"):
            key = "id" if self.kinds[ends[0]] == "node" else "edge_id"
            a, b = (F.col(f"{x}__{key}") for x in ends)
        else:
            a, b = self.column(left), self.column(right)
        return {
            "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b,
            "starts": lambda: F.startswith(a, b), "ends": lambda: F.endswith(a, b), "contains": lambda: F.contains(a, b), "=~": lambda: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))),
        }[op]()

    def comprehension(self, var: str, src: tuple, where: tuple | None, out: tuple) -> Column:
        def inside(e: tuple):
            def of(x: Column) -> Column:
                before = dict(self.local)
                self.local[var] = x
                try:
                    return self.column(e)
                finally:
                    self.local = before

            return of

        items = self.column(src)
        if where is not None:
            items = F.filter(items, inside(where))
        return F.transform(items, inside(out))

    def call(self, e: tuple) -> Column:
        _, name, distinct, args = e
        if name in AGGREGATES:
            return self.aggregate(name, distinct, args[0])
        of = args[0] if args else None
        kind = self.kinds.get(of[1]) if of and of[0] == "var" and of[1] not in self.local else None
        if name == "id":
            return F.col(f"{of[1]}__id") if kind == "node" else F.col(f"{of[1]}__edge_id") if kind == "rel" else self.column(of)["id"]
        if name == "labels":
            return F.array(F.col(f"{of[1]}__label")) if kind == "node" else F.array(self.column(of)["label"])
        if name == "type":
            return F.col(f"{of[1]}__type") if kind == "rel" else self.column(of)["type"]
        if name in ("nodes", "relationships", "rels"):
            return F.col(f"{of[1]}__{'nodes' if name == 'nodes' else 'rels'}")
        if name in ("startnode", "endnode"):
            return F.col(f"{of[1]}__{'src' if name == 'startnode' else 'dst'}")
        if name in ("keys", "properties") and kind in ("node", "rel"):
            cols = [c for c in (self.g.node_columns if kind == "node" else self.g.edge_columns) if c not in ("props", "labels", "src", "dst", "edge_id")]
            m = F.map_filter(F.create_map(*[x for c in cols for x in (F.lit(c), F.col(f"{of[1]}__{c}").cast("string"))]), lambda k, v: v.isNotNull())
            return F.array_sort(F.map_keys(m)) if name == "keys" else m
        if name in ("length", "size") and kind == "path":
            return F.size(f"{of[1]}__rels")
        if name == "size" and of and of[:2] == ("call", "collect") and of[3][0][0] == "prop":
            # Collected values are counted without a list of them.
            c = self.column(of[3][0])
            return (F.count_distinct(c) if of[2] else F.count(c)).cast("int")
        a = [self.column(x) for x in args]
        text = of is not None and (of[0] == "lit" and isinstance(of[1], str) or of[0] == "prop" or of[0] == "call" and of[1] in ("tolower", "toupper", "trim", "tostring"))
        simple = {
            "exists": lambda: a[0].isNotNull(),
            "coalesce": lambda: F.coalesce(*a),
            "tolower": lambda: F.lower(a[0]),
            "toupper": lambda: F.upper(a[0]),
            "trim": lambda: F.regexp_replace(F.regexp_replace(a[0], r"^\s+", ""), r"\s+$", ""),
            "tostring": lambda: a[0].cast("string"),
            "tointeger": lambda: F.regexp_extract(F.trim(a[0].cast("string")), r"^([+-]?\d+)", 1).try_cast("bigint"),
            "tofloat": lambda: a[0].try_cast("double"),
            "head": lambda: F.try_element_at(a[0], F.lit(1)),
            "last": lambda: F.try_element_at(a[0], F.lit(-1)),
            "tail": lambda: F.slice(a[0], F.lit(2), F.greatest(F.size(a[0]) - 1, F.lit(0))),
            "size": lambda: F.char_length(a[0]) if text else F.size(a[0]),
            "length": lambda: F.octet_length(a[0]) if text else F.size(a[0]),
            "split": lambda: F.split(a[0], F.concat(F.lit("\\Q"), a[1], F.lit("\\E"))),
            "replace": lambda: F.replace(a[0], a[1], a[2]),
            "substring": lambda: F.substring(a[0], a[1] + 1, a[2]) if len(a) > 2 else F.substr(a[0], a[1] + 1),
            "reverse": lambda: F.reverse(a[0]),
            "range": lambda: F.sequence(*a),
            "abs": lambda: F.abs(a[0]),
            "round": lambda: F.round(a[0]),
            "floor": lambda: F.floor(a[0]),
            "ceil": lambda: F.ceil(a[0]),
            "sqrt": lambda: F.sqrt(a[0]),
            "log": lambda: F.log(a[0]),
        }
        from ..functions.registry import FUNCTIONS

        if name in simple:
            return simple[name]()
        if name in FUNCTIONS:
            return FUNCTIONS[name](*a)
        raise CypherError(f"{name} isn't a function")

    def aggregate(self, name: str, distinct: bool, of: tuple) -> Column:
        if of == ("star",):
            return F.count(F.lit(1))
        kind = self.kinds.get(of[1]) if of[0] == "var" else None
        c = F.col(f"{of[1]}__{'id' if kind == 'node' else 'edge_id'}") if kind in ("node", "rel") and name == "count" else self.column(of)
        if name == "count":
            return F.count_distinct(c) if distinct else F.count(c)
        if name == "collect":
            return F.collect_set(c) if distinct else F.collect_list(c)
        if name == "sum":
            return F.coalesce((F.sum_distinct(c) if distinct else F.sum(c)).cast("double"), F.lit(0.0))
        return {"avg": F.avg, "min": F.min, "max": F.max}[name](c)

    # Patterns

    def nodes_as(self, var: str, n) -> DataFrame:
        df = self.g.nodes_with(n.labels)
        df = df.select(*[F.col(c).alias(f"{var}__{c}") for c in df.columns])
        return self.restrict(df, var, n.props, "node")

    def edges_as(self, var: str, r: Rel) -> DataFrame:
        df = self.g.edges_with(r.types)
        df = df.select(*[F.col(c).alias(f"{var}__{c}") for c in df.columns])
        df = self.restrict(df, var, r.props, "rel")
        if r.direction == "both":
            back = df.withColumns({f"{var}__from": F.col(f"{var}__dst"), f"{var}__to": F.col(f"{var}__src")}).filter(F.col(f"{var}__src") != F.col(f"{var}__dst"))
            return df.withColumns({f"{var}__from": F.col(f"{var}__src"), f"{var}__to": F.col(f"{var}__dst")}).unionByName(back)
        a, b = ("src", "dst") if r.direction == "out" else ("dst", "src")
        return df.withColumns({f"{var}__from": F.col(f"{var}__{a}"), f"{var}__to": F.col(f"{var}__{b}")})

    def restrict(self, df: DataFrame, var: str, props: dict, kind: str) -> DataFrame:
        before = self.kinds.get(var)
        self.kinds[var] = kind
        for k, e in props.items():
            df = df.filter(self.prop(("var", var), k) == self.column(e))
        if before is None:
            del self.kinds[var]
        return df

    def with_path(self, df: DataFrame | None, p: Path, bound: dict[str, str], seen: set[str], used: list[Rel]) -> DataFrame:
        """Join a path's pattern to ``df``; ``bound`` grows by its names."""
        def place(n, df: DataFrame | None, key: str | None) -> DataFrame:
            """Bind a node; its id is column ``key`` if given."""
            if bound.get(n.var) == "node":
                if key is not None:
                    df = df.filter(F.col(key) == F.col(f"{n.var}__id"))
                return df
            bare = not n.labels and not n.props and n.var not in seen and p.var is None
            bound[n.var] = "node"
            if key is not None and bare:
                return df.withColumn(f"{n.var}__id", F.col(key))
            own = self.nodes_as(n.var, n)
            if key is not None:
                return df.join(own, F.col(key) == F.col(f"{n.var}__id"))
            return own if df is None else df.crossJoin(own)

        first, rels, nodes = p.nodes[0], p.rels, p.nodes
        # Begin at an end that is bound, or else has a property to match.
        if rels and bound.get(first.var) != "node" and (bound.get(nodes[-1].var) == "node" or (nodes[-1].props and not first.props)) and p.var is None:
            nodes = nodes[::-1]
            turn = {"out": "in", "in": "out", "both": "both"}
            rels = [Rel(r.var, r.types, r.props, turn[r.direction], r.low, r.high, r.named) for r in rels[::-1]]
            first = nodes[0]
        bare_start = rels and bound.get(first.var) != "node" and not first.labels and not first.props and first.var not in seen and p.var is None and rels[0].low is None
        if bare_start and df is None:
            r = rels[0]
            df = self.edges_as(r.var, r)
            df = df.withColumn(f"{first.var}__id", F.col(f"{r.var}__from"))
            bound[first.var], bound[r.var] = "node", "rel"
            used.append(r)
            df = place(nodes[1], df, f"{r.var}__to")
            rest = list(zip(rels[1:], nodes[1:], nodes[2:]))
        else:
            df = place(first, df, None)
            rest = list(zip(rels, nodes, nodes[1:]))
        for r, a, b in rest:
            if r.low is not None or r.high is not None:
                df = self.hops(df, r, a.var, bound, p, used)
                used.append(r)
                df = place(b, df, f"{r.var}__end")
                continue
            df = df.join(self.edges_as(r.var, r), F.col(f"{a.var}__id") == F.col(f"{r.var}__from"))
            df = self.apart(df, r, used, f"{r.var}__edge_id")
            bound[r.var] = "rel"
            used.append(r)
            df = place(b, df, f"{r.var}__to")
        if p.var is not None:
            bound[p.var] = "path"
            keep = [c for c in ("id", "label", "name", "filePath") if c in self.g.node_columns]
            struct = lambda v: F.struct(*[F.col(f"{v}__{c}").alias(c) for c in keep])
            parts_n, parts_r = [F.array(struct(nodes[0].var))], []
            for r, b in zip(rels, nodes[1:]):
                if r.low is not None:
                    parts_n.append(F.col(f"{r.var}__inner"))
                    parts_r.append(F.col(f"{r.var}__rels"))
                    continue
                parts_n.append(F.array(struct(b.var)))
                parts_r.append(F.array(F.struct(*[F.col(f"{r.var}__{c}").alias(c) for c in ("edge_id", "type", "src", "dst")])))
            df = df.withColumns({f"{p.var}__nodes": F.concat(*parts_n), f"{p.var}__rels": F.concat(*parts_r) if parts_r else F.array()})
        return df

    def apart(self, df: DataFrame, r: Rel, used: list[Rel], edge: str) -> DataFrame:
        """Rows whose edge isn't one that the clause has used already."""
        for other in used:
            if r.types and other.types and not set(r.types) & set(other.types):
                continue
            if other.low is not None or other.high is not None:
                df = df.filter(~F.exists(f"{other.var}__rels", lambda x: x["edge_id"] == F.col(edge)))
            else:
                df = df.filter(F.col(edge) != F.col(f"{other.var}__edge_id"))
        return df

    def hops(self, df: DataFrame, r: Rel, start: str, bound: dict[str, str], p: Path, used: list[Rel]) -> DataFrame:
        """Variable length by unrolled joins; no relationship occurs twice."""
        low, high = r.low or 0, self.max_hops if r.high is None else r.high
        v = r.var
        keep = [c for c in ("id", "label", "name", "filePath") if c in self.g.node_columns]
        step_rel = F.struct(*[F.col(f"_h__{c}").alias(c) for c in ("edge_id", "type", "src", "dst")])
        rel_type = "array<struct<edge_id:string,type:string,src:string,dst:string>>"
        node_type = "array<struct<" + ",".join(f"{c}:string" for c in keep) + ">>"
        now = df.withColumns({f"{v}__end": F.col(f"{start}__id"), f"{v}__rels": F.array().cast(rel_type), f"{v}__inner": F.array().cast(node_type)})
        hop = Rel("_h", r.types, r.props, r.direction)
        parts = [now] if low == 0 else []
        k = 0
        while high is None or k < high:
            k += 1
            e = self.edges_as("_h", hop).select("_h__from", "_h__to", *[f"_h__{c}" for c in ("edge_id", "type", "src", "dst")])
            now = now.join(e, F.col(f"{v}__end") == F.col("_h__from"))
            now = now.filter(~F.exists(f"{v}__rels", lambda x: x["edge_id"] == F.col("_h__edge_id")))
            now = self.apart(now, hop, used, "_h__edge_id")
            now = now.withColumns({f"{v}__end": F.col("_h__to"), f"{v}__rels": F.concat(f"{v}__rels", F.array(step_rel))})
            if p.var is not None and not self.read_of(p.var) - {"id"}:
                # Nobody looks at more than the ids of these nodes.
                bare = F.struct(*[(F.col(f"{v}__end") if c == "id" else F.lit(None)).cast("string").alias(c) for c in keep])
                now = now.withColumn(f"{v}__inner", F.concat(f"{v}__inner", F.array(bare)))
            elif p.var is not None:
                n = self.g.nodes.select(F.col("id").alias("_n__id"), F.struct(*[F.col(c).cast("string").alias(c) for c in keep]).alias("_n__all"))
                now = now.join(n, F.col(f"{v}__end") == F.col("_n__id")).withColumn(f"{v}__inner", F.concat(f"{v}__inner", F.array("_n__all"))).drop("_n__id", "_n__all")
            now = now.drop(*[c for c in now.columns if c.startswith("_h__")])
            if high is None:
                now = written(now)
                if now.isEmpty():
                    break
            if k >= low:
                parts.append(now)
        if not parts:
            parts = [now.filter("false")]
        bound[v] = "rels"
        return reduce(DataFrame.unionByName, parts)

    def read_of(self, path: str) -> set[str]:
        """Properties of a path's nodes that the query reads."""
        said = []
        for part in self.query.parts:
            if isinstance(part, Match):
                said.append(part.where)
            elif isinstance(part, Projection):
                said += [*(i.expr for i in part.items), *(e for e, _ in part.order), part.where, *([("var", path)] if part.star else [])]
            else:
                said.append(part.expr)
        return _path_fields(said, path)

    # Clauses

    def conjuncts(self, e: tuple | None) -> list[tuple]:
        if e is None:
            return []
        return self.conjuncts(e[1]) + self.conjuncts(e[2]) if e[0] == "and" else [e]

    def where(self, df: DataFrame, e: tuple | None) -> DataFrame:
        for c in self.conjuncts(e):
            negated = c[0] == "not" and c[1][0] == "pattern"
            if c[0] == "pattern" or negated:
                df = self.semi(df, (c[1][1] if negated else c[1]), "left_anti" if negated else "left_semi")
                continue
            flags: list[str] = []
            df, c = self.flagged(df, c, flags)
            df = df.filter(self.column(c)).drop(*flags)
        return df

    def flagged(self, df: DataFrame, e, flags: list[str]) -> tuple[DataFrame, object]:
        """A condition whose patterns are columns, joined to the rows as flags."""
        if isinstance(e, tuple) and e and e[0] == "pattern":
            keys, on = self.keys_of(e[1])
            self.serial += 1
            name = f"_f{self.serial}"
            flags.append(name)
            marked = keys.withColumn(name, F.lit(True))
            df = df.join(marked, on, "left").drop(*keys.columns) if on is not None else df.join(F.broadcast(marked.limit(1).select(name)), F.lit(True), "left")
            return df, ("flag", name)
        if isinstance(e, tuple | list):
            out = []
            for x in e:
                df, y = self.flagged(df, x, flags)
                out.append(y)
            return df, type(e)(out)
        return df, e

    def keys_of(self, p: Path) -> tuple[DataFrame, list[Column] | None]:
        """Distinct ids of a pattern's bound nodes, and how rows join them.

        None where the pattern has no node in common with the rows: then it
        holds for all rows or for none.
        """
        shared = list(dict.fromkeys(n.var for n in p.nodes if self.kinds.get(n.var) == "node"))
        bound: dict[str, str] = {}
        before = dict(self.kinds)
        own = self.with_path(None, p, bound, set(), [])
        self.kinds = before
        self.serial += 1
        names = [f"_k{self.serial}_{i}" for i in range(len(shared))]
        if not shared:
            return own.select(F.lit(1).alias(f"_k{self.serial}")), None
        keys = own.select(*[F.col(f"{v}__id").alias(k) for v, k in zip(shared, names)]).distinct()
        return keys, [F.col(f"{v}__id") == F.col(k) for v, k in zip(shared, names)]

    def semi(self, df: DataFrame, p: Path, how: str) -> DataFrame:
        """Keep rows that have, or don't have, the pattern."""
        keys, on = self.keys_of(p)
        return df.join(keys, on, how) if on is not None else df.join(F.broadcast(keys.limit(1)), F.lit(True), how)

    def match(self, m: Match, seen: set[str]) -> None:
        if m.optional:
            self.optional(m, seen)
            return
        used: list[Rel] = []
        for p in m.paths:
            self.df = self.with_path(self.df, p, self.kinds, seen, used)
        self.df = self.where(self.df, m.where)

    def optional(self, m: Match, seen: set[str]) -> None:
        """Left join on the ids of the names that are bound already."""
        shared = [n.var for p in m.paths for n in p.nodes if self.kinds.get(n.var) == "node"]
        shared = list(dict.fromkeys(shared))
        bound: dict[str, str] = {}
        outer, kinds = self.df, self.kinds
        right, used = None, []
        for p in m.paths:
            # Of a name that is bound already the right side needs the id alone.
            right = self.with_path(right, p, bound, (seen - set(shared)) | _variables(m.where), used)
        self.kinds = {**kinds, **bound}
        right = self.where(right, m.where)
        mapped = right.select(*[F.col(f"{v}__id").alias(f"_k{i}") for i, v in enumerate(shared)], *[c for c in right.columns if c.split("__")[0] not in shared])
        on = [F.col(f"{v}__id") == F.col(f"_k{i}") for i, v in enumerate(shared)]
        self.df = outer.join(mapped, on, "left").drop(*[f"_k{i}" for i in range(len(shared))])

    def project(self, p: Projection) -> None:
        items = list(p.items)
        if p.star:
            from .parser import Item

            items = [Item(("var", k), k) for k, v in self.kinds.items() if not k.startswith("_v")] + items
        aliases = {i.alias: i.expr for i in items}
        hidden, order = [], []
        for e, down in p.order:
            if e[0] == "var" and e[1] in aliases:
                name = e[1]
            else:
                name = next((a for a, x in aliases.items() if x == e), None)
                if name is None:
                    name = f"_o{len(hidden)}"
                    hidden.append((name, self.expand(e, aliases)))
            order.append((name, down))
        values, groups, kinds = [], [], {}
        grouped = any(_has_aggregate(i.expr) for i in items) or any(_has_aggregate(e) for _, e in hidden)
        carried: list[Column] = []
        for i in items:
            kind = self.kinds.get(i.expr[1]) if i.expr[0] == "var" else None
            if kind in ("node", "rel", "path", "rels") and not p.final:
                # The whole variable goes on under its new name.
                cols = [c for c in self.df.columns if c.startswith(f"{i.expr[1]}__")]
                key = {"node": "id", "rel": "edge_id"}.get(kind)
                for c in cols:
                    new = f"{i.alias}__{c.split('__', 1)[1]}"
                    if grouped and key and c != f"{i.expr[1]}__{key}":
                        carried.append(F.first(c).alias(new))
                    else:
                        groups.append(F.col(c).alias(new))
                kinds[i.alias] = kind
                continue
            (values if _has_aggregate(i.expr) else groups).append(self.column(i.expr).alias(i.alias))
            kinds[i.alias] = "value"
        extra = [self.column(e).alias(n) for n, e in hidden]
        df = self.df
        if grouped:
            plain = [x for (n, e), x in zip(hidden, extra) if not _has_aggregate(e)]
            agg = values + carried + [x for (n, e), x in zip(hidden, extra) if _has_aggregate(e)]
            df = df.groupBy(*groups, *plain).agg(*agg)
        else:
            df = df.select(*groups, *values, *extra)
        if p.distinct:
            df = df.distinct()
        if order:
            df = df.orderBy(*[F.col(f"`{n}`").desc_nulls_first() if d else F.col(f"`{n}`").asc_nulls_last() for n, d in order])
        if p.skip is not None:
            df = df.offset(int(self.number(p.skip)))
        if p.limit is not None:
            df = df.limit(int(self.number(p.limit)))
        self.df, self.kinds = df, kinds
        if p.final:
            self.df = df.select(*[f"`{i.alias}`" for i in items])
        else:
            self.df = self.where(df.drop(*[n for n, _ in hidden]), p.where)

    def factored(self, m: Match, p: Projection, seen: set[str]) -> bool:
        """Aggregate the branches of a pattern around one node apart, where that is the same.

        It is if the groups are of that node, and each aggregate either looks
        at one branch and at distinct values, least or greatest ones, or counts
        all rows. The branches' product is then never built: rows are counted
        as the product of the branches' counts, less those in which the two
        ends that must differ are one. True if the clauses are done.
        """
        items = {i.alias: i.expr for i in p.items}
        aggs = {a: e for a, e in items.items() if _has_aggregate(e)}
        groups = {a: e for a, e in items.items() if a not in aggs}
        named = set().union(*map(_variables, groups.values())) if groups else set()
        order = [(e[1] if e[0] == "var" and e[1] in items else next((a for a, x in items.items() if x == e), None), down) for e, down in p.order]
        if m.optional or p.star or p.distinct or not aggs or len(named) != 1 or any(a is None for a, _ in order):
            return False
        centre = named.pop()
        if any(e[0] == "var" and e[1] == centre for e in groups.values()):
            return False
        at = [n for path in m.paths for n in path.nodes if n.var == centre]
        plain = all(path.var is None and all(r.low is None and r.high is None for r in path.rels) for path in m.paths)
        if not at or not plain or any(n.labels or n.props for n in at[1:]) or any(_variables(x.props) for path in m.paths for x in (*path.nodes, *path.rels)):
            return False
        # Paths between the places where they meet the node.
        pieces: list[Path] = []
        for path in m.paths:
            cut = [0, *(i for i, n in enumerate(path.nodes) if n.var == centre and 0 < i < len(path.nodes) - 1), len(path.nodes) - 1]
            nodes = [at[0] if n.var == centre else n for n in path.nodes]
            pieces += [Path(nodes[a : b + 1], path.rels[a:b]) for a, b in zip(cut, cut[1:]) if b > a]
        branches: list[tuple[set[str], list[Path]]] = []
        for piece in pieces:
            own = {n.var for n in piece.nodes} - {centre}
            if not own:
                return False
            own |= {r.var for r in piece.rels}
            like = [b for b in branches if b[0] & own]
            branches = [b for b in branches if b not in like] + [(own.union(*(b[0] for b in like)), [x for b in like for x in b[1]] + [piece])]
        if len(branches) < 2 or not all(any(n.var == centre for path in b[1] for n in path.nodes) for b in branches):
            return False
        of = lambda e: [k for k, b in enumerate(branches) if b[0] & _variables(e)]
        wheres: list[list[tuple]] = [[] for _ in branches]
        apart: list[tuple[int, str, int, str]] = []
        for c in self.conjuncts(m.where):
            if _mentions_pattern(c):
                return False
            mine = of(c)
            if len(mine) < 2:
                for k in mine or range(len(branches)):
                    wheres[k].append(c)
            elif c[:2] == ("cmp", "<>") and all(x[0] == "var" and any(n.var == x[1] for path in m.paths for n in path.nodes) for x in c[2:4]):
                apart.append((of(c[2])[0], c[2][1], of(c[3])[0], c[3][1]))
            else:
                return False
        counts = all(e == ("call", "count", False, [("star",)]) for e in aggs.values())
        if apart and not (counts and len(apart) == 1 and len(branches) == 2):
            return False
        if not counts and not all(len(of(e)) <= 1 and _variables(e) and _ignores_repeats(e) for e in aggs.values()):
            return False
        # Two edges of different branches must differ by their types or by their far ends.
        ends = {frozenset((apart[0][1], apart[0][3]))} if apart else set()
        steps = [(k, r, {path.nodes[i].var, path.nodes[i + 1].var} - {centre}) for k, b in enumerate(branches) for path in b[1] for i, r in enumerate(path.rels)]
        for i, (k, r, a) in enumerate(steps):
            for j, q, b in steps[i + 1 :]:
                if k != j and not (r.types and q.types and not set(r.types) & set(q.types)) and (len(a) != 1 or len(b) != 1 or frozenset(a | b) not in ends):
                    return False

        key, frames = f"{centre}__id", []
        for (_, paths), where in zip(branches, wheres):
            self.kinds, used, df = {}, [], None
            for path in paths:
                df = self.with_path(df, path, self.kinds, seen | {centre}, used)
            df = self.where(df, reduce(lambda a, b: ("and", a, b), where) if where else None)
            frames.append((df, self.kinds))
        by = lambda: [self.column(e).alias(f"_g{i}") for i, e in enumerate(groups.values())]
        names = [f"_g{i}" for i in range(len(groups))]
        if counts:
            whole = None
            for k, (df, self.kinds) in enumerate(frames):
                one = df.groupBy(key, *(by() if k == 0 else [])).agg(F.count(F.lit(1)).alias(f"_c{k}"))
                whole = one if whole is None else whole.join(one, key)
            n = reduce(lambda a, b: a * b, [F.col(f"_c{k}") for k in range(len(frames))])
            for i, a, j, b in apart:
                met = [frames[k][0].groupBy(key, F.col(f"{v}__id").alias("_x")).agg(F.count(F.lit(1)).alias(f"_m{x}")) for x, (k, v) in enumerate(((i, a), (j, b)))]
                same = met[0].join(met[1], [key, "_x"]).groupBy(key).agg(F.sum(F.col("_m0") * F.col("_m1")).alias("_same"))
                whole, n = whole.join(same, key, "left"), n - F.coalesce("_same", F.lit(0))
            whole = whole.withColumn("_n", n).filter("_n > 0").groupBy(*names).agg(F.sum("_n").alias("_n"))
            df = whole.select(*[F.col(g).alias(a) for g, a in zip(names, groups)], *[F.col("_n").alias(a) for a in aggs])
        else:
            df = None
            for k, (own, self.kinds) in enumerate(frames):
                mine = {a: e for a, e in aggs.items() if (of(e) or [0]) == [k]}
                if not mine:
                    continue
                for j, (other, _) in enumerate(frames):
                    if j != k:
                        own = own.join(other.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_semi")
                part = own.groupBy(*by()).agg(*[self.column(e).alias(a) for a, e in mine.items()])
                if df is None:
                    df = part
                else:
                    part = part.withColumnsRenamed({g: f"{g}r" for g in names})
                    df = df.join(part, reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"{g}r")) for g in names])).drop(*[f"{g}r" for g in names])
            df = df.withColumnsRenamed(dict(zip(names, groups)))
        self.kinds = {a: "value" for a in items}
        df = df.select(*[f"`{a}`" for a in items])
        if order:
            df = df.orderBy(*[F.col(f"`{n}`").desc_nulls_first() if d else F.col(f"`{n}`").asc_nulls_last() for n, d in order])
        if p.skip is not None:
            df = df.offset(int(self.number(p.skip)))
        if p.limit is not None:
            df = df.limit(int(self.number(p.limit)))
        self.df = df if p.final else self.where(df, p.where)
        return True

    def number(self, e: tuple) -> int:
        return self.params[e[1]] if e[0] == "param" else e[1]

    def expand(self, e, aliases: dict):
        """Put aliases' expressions in place of their names."""
        if isinstance(e, tuple):
            if e and e[0] == "var" and e[1] in aliases and e[1] not in self.kinds:
                return aliases[e[1]]
            return tuple(self.expand(x, aliases) for x in e)
        return [self.expand(x, aliases) for x in e] if isinstance(e, list) else e

    def run(self) -> DataFrame:
        parts, done = self.query.parts, None
        for k, part in enumerate(parts):
            if part is done:
                continue
            if isinstance(part, Match):
                # Names that anything else looks at need their node's columns.
                seen = _variables(part.where)
                for later in parts[k + 1 :]:
                    if isinstance(later, Match):
                        seen |= _variables(later.where) | {n.var for p in later.paths for n in p.nodes if n.props}
                    elif isinstance(later, Projection):
                        seen |= _variables([i.expr for i in later.items]) | _variables([e for e, _ in later.order]) | _variables(later.where)
                        if later.star:
                            seen |= {n.var for p in part.paths for n in p.nodes}
                    elif isinstance(later, Unwind):
                        seen |= _variables(later.expr)
                after = parts[k + 1] if k + 1 < len(parts) else None
                if self.df is None and isinstance(after, Projection) and self.factored(part, after, seen):
                    done = after
                else:
                    self.match(part, seen)
            elif isinstance(part, Unwind):
                self.df = self.df.withColumn(part.alias, F.explode(self.column(part.expr)))
                self.kinds[part.alias] = "value"
            else:
                self.project(part)
        return self.df


def cypher(graph: PropertyGraph, text: str, max_hops: int | None = None, **params) -> DataFrame:
    """The result of a read-only query as a lazy DataFrame.

    A variable length without an upper bound ends at ``max_hops``, if given;
    else its hops are worked out at once, until no path can be made longer.
    """
    return _Lowering(graph, parse(text), params, max_hops).run()
