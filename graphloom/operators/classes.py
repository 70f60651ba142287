"""Class hierarchies: parents, ambiguous methods, overrides, linearization."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from .graph import PropertyGraph
from .traverse import set_containment

# Labels of classes, and how languages choose between inherited methods.
CLASS_LABELS = ("Class", "Struct", "Interface", "Trait")
CONCRETE_LABELS = ("Class", "Struct")
CLASS_FIRST, NEVER = ("java", "csharp"), ("rust",)
#: Order of choice where a parent's name fits several types.
PARENT_ORDER = ("Class", "Interface", "Struct", "Trait")


def parents(graph: PropertyGraph) -> DataFrame:
    """Direct parents of classes: child, parent, kind and place (EXTENDS first, then step, then id)."""
    e = graph.edges_of("EXTENDS", "IMPLEMENTS").join(graph.by_label(*CLASS_LABELS).select(F.col("id").alias("src")), "src", "left_semi")
    place = F.struct((F.col("type") != "EXTENDS").alias("late"), F.coalesce("step", F.lit(2**31 - 1)).alias("step"), F.col("dst").alias("at"))
    return e.groupBy(F.col("src").alias("child"), F.col("dst").alias("parent")).agg(F.min(place).alias("place"))


def _methods(graph: PropertyGraph) -> DataFrame:
    own = graph.edges_of("HAS_METHOD").select(F.col("src").alias("owner"), F.col("dst").alias("method")).distinct()
    return own.join(graph.by_label("Method").select(F.col("id").alias("method"), F.col("name").alias("method_name")), "method")


def ambiguities(graph: PropertyGraph) -> DataFrame:
    """Methods that a class inherits from two or more direct parents.

    Columns child, method_name, n (different methods), resolved (method id or
    null). A method of the class itself shadows them. Java and C# take the one
    class's method, Rust never chooses, the others take the leftmost parent's.
    A group holds one method name of one class; its aggregate is partial.
    """
    m = _methods(graph)
    lang = graph.nodes.select(F.col("id").alias("child"), F.lower("language").alias("language"))
    solid = graph.nodes.select(F.col("id").alias("owner"), F.col("label").isin(*CONCRETE_LABELS).alias("solid"))
    shadow = m.select(F.col("owner").alias("child"), "method_name").distinct()
    found = parents(graph).withColumnRenamed("parent", "owner").join(m, "owner").join(shadow, ["child", "method_name"], "left_anti").join(solid, "owner")
    # One method may be reached by several parents.
    found = found.groupBy("child", "method_name", "method").agg(F.min("place").alias("place"), F.max("solid").alias("solid"))
    per = found.groupBy("child", "method_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("solid").cast("long")).alias("classes"), F.min_by("method", F.struct("place", "method")).alias("left"), F.min(F.when(F.col("solid"), F.col("method"))).alias("only")
    )
    language = F.coalesce("language", F.lit(""))
    resolved = F.when(language.isin(*NEVER), None).when(language.isin(*CLASS_FIRST), F.when(F.col("classes") == 1, F.col("only"))).otherwise(F.col("left"))
    return per.filter("n > 1").join(lang, "child").select("child", "method_name", "n", resolved.alias("resolved"))


def override_edges(found: DataFrame) -> DataFrame:
    """OVERRIDES edges from class to method for resolved ambiguities."""
    e = found.filter("resolved is not null").select(F.col("child").alias("src"), F.col("resolved").alias("dst"), F.lit("OVERRIDES").alias("type"))
    return e.distinct().withColumn("edge_id", model.edge_id("src", "dst", "type"))


def overrides(graph: PropertyGraph) -> DataFrame:
    """Methods of a class that share their name with one of a direct parent: child, method, parent, base."""
    m = _methods(graph)
    own = m.toDF("method", "child", "method_name")
    base = m.toDF("base", "parent", "method_name")
    return own.join(parents(graph).select("child", "parent"), "child").join(base, ["parent", "method_name"]).select("child", "method", "parent", "base")


def heritage(records: DataFrame, types: DataFrame) -> DataFrame:
    """Resolve parents by name: child, parent and type of the edge.

    ``records`` is (child, parentName, kind), ``types`` (id, name, label). Of
    several types with the name the label decides in the order Class,
    Interface, Struct, Trait, then the id. To extend an interface or a trait is
    to implement it. Unknown names give no row.
    """
    order = F.array_position(F.array(*map(F.lit, PARENT_ORDER)), F.col("label"))
    best = types.filter(F.col("label").isin(*PARENT_ORDER)).groupBy(F.col("name").alias("parentName")).agg(F.min_by(F.struct("id", "label"), F.struct(order, F.col("id"))).alias("t"))
    kind = F.when((F.lower("kind") == "extends") & ~F.col("t.label").isin("Interface", "Trait"), "EXTENDS").otherwise("IMPLEMENTS")
    return records.join(best, "parentName").filter(F.col("child") != F.col("t.id")).select("child", F.col("t.id").alias("parent"), kind.alias("type")).distinct()


def inferred_interfaces(graph: PropertyGraph) -> DataFrame:
    """Structs that have all methods of an interface and no edge to it yet: child, parent."""
    m = _methods(graph).select("owner", F.col("method_name").alias("item"))
    of = lambda label: m.join(graph.by_label(label).select(F.col("id").alias("owner")), "owner", "left_semi")
    found = set_containment(of("Struct"), of("Interface").withColumnRenamed("owner", "whole"))
    known = graph.edges_of("IMPLEMENTS").select(F.col("src").alias("owner"), F.col("dst").alias("whole"))
    return found.join(known, ["owner", "whole"], "left_anti").toDF("child", "parent")


def linearize(name: str, bases: Mapping[str, Sequence[str]]) -> list[str]:
    """C3 order of a class and its ancestors; ValueError if there is none or a cycle."""
    active: set[str] = set()

    def order(c: str) -> list[str]:
        if c in active:
            raise ValueError(f"{c} is its own ancestor")
        active.add(c)
        direct = list(bases.get(c, ()))
        rows = [r for r in [*(order(b) for b in direct), direct] if r]
        active.discard(c)
        out = [c]
        while rows:
            tails = {x for r in rows for x in r[1:]}
            head = next((r[0] for r in rows if r[0] not in tails), None)
            if head is None:
                raise ValueError(f"no consistent order of the bases of {c}")
            out.append(head)
            rows = [k for r in rows if (k := r[1:] if r[0] == head else r)]
        return out

    return order(name)

