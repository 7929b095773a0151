"""Resolution of names, namespaces and inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ascii_lower, depth, like, parent
from ..plans.store import scratch

_UNDER = "translate(qualified_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE concat(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.%') ESCAPE '\x01'"


def _choice() -> Column:
    """Of several symbols of one name: classes, then modules, then others; then by id."""
    kind = F.when(F.col("symbol_type") == "class", 0).when(F.col("symbol_type") == "module", 1).otherwise(2)
    return F.min(F.struct(kind.alias("kind"), "id", "qualified_name")).alias("best")


def unambiguous(symbols: DataFrame, wanted: DataFrame, max_gap: int) -> DataFrame:
    """(query, qualified_name) of what lies under a prefix by its last name, if that is one thing.

    ``wanted`` has query, prefix and name. Classes and modules may lie at any depth below the prefix,
    others at most ``max_gap`` levels further than directly. If candidates have several parents, those
    of the least depth decide; of one parent's candidates the shortest is taken, then the first by id.
    """
    met = symbols.select("id", "name", "qualified_name", "symbol_type").join(wanted, "name").filter(F.expr(_UNDER.format("prefix")))
    gap = depth("qualified_name") - depth("prefix") - 1
    met = met.filter(F.col("symbol_type").isin("class", "module") | (gap <= max_gap))
    levels = met.groupBy("query", depth("qualified_name").alias("level")).agg(
        F.count_distinct(parent("qualified_name")).alias("parents"), F.min(F.struct(F.length("qualified_name").alias("size"), "id", "qualified_name")).alias("best")
    )
    # Names of different depths have different parents.
    top = levels.groupBy("query").agg(F.sum("parents").alias("parents"), F.min("best").alias("best"), F.min(F.struct("level", "parents", "best")).alias("shallow"))
    found = F.when(F.col("parents") == 1, F.col("best.qualified_name")).when(F.col("shallow.parents") == 1, F.col("shallow.best.qualified_name"))
    return top.select("query", found.alias("qualified_name")).filter("qualified_name is not null")


def resolve(symbols: DataFrame, names: list[str]) -> DataFrame:
    """(query, qualified_name) of each name that can be resolved.

    By turns: the qualified name itself; a symbol of that name; one whatever its case; what lies
    unambiguously under the prefix; what lies directly under the prefix once that is resolved itself.
    """
    spark = symbols.sparkSession
    every = sorted({".".join(n.split(".")[:i]) for n in names for i in range(1, n.count(".") + 2)})
    asked = spark.createDataFrame([(n,) for n in every], "query string")
    keyed = symbols.select("id", "name", "qualified_name", "symbol_type")
    by_key = keyed.join(F.broadcast(asked), F.col("qualified_name") == F.col("query")).select("query", "qualified_name", F.lit(1).alias("step"))
    by_name = keyed.join(F.broadcast(asked), F.col("name") == F.col("query")).groupBy("query").agg(_choice()).select("query", "best.qualified_name", F.lit(2).alias("step"))
    folded = keyed.join(F.broadcast(asked), ascii_lower("name") == ascii_lower("query")).groupBy("query").agg(_choice()).select("query", "best.qualified_name", F.lit(3).alias("step"))
    direct = by_key.unionByName(by_name).unionByName(folded)
    dotted = asked.filter(F.contains("query", F.lit("."))).select("query", parent("query").alias("prefix"), F.regexp_extract("query", r"([^.]*)$", 1).alias("name"))
    direct = direct.unionByName(unambiguous(symbols, dotted, 1).withColumn("step", F.lit(4)))
    done = direct.groupBy("query").agg(F.min_by("qualified_name", "step").alias("qualified_name"), F.min("step").alias("step"))
    for level in range(1, max((n.count(".") for n in names), default=0) + 1):
        # Prefixes of one dot less are resolved by now.
        open_ = dotted.filter(depth("query") == level).join(done.select("query"), "query", "left_anti")
        chained = open_.join(done.select(F.col("query").alias("prefix"), F.col("qualified_name").alias("resolved")), "prefix")
        found = unambiguous(symbols, chained.select("query", "name", F.col("resolved").alias("prefix")), 0)
        done = done.unionByName(found.withColumn("step", F.lit(5)))
    return done.join(F.broadcast(spark.createDataFrame([(n,) for n in sorted(set(names))], "query string")), "query")


def resolve_one(symbols: DataFrame, name: str) -> str | None:
    row = resolve(symbols, [name]).first() if name else None
    return row.qualified_name if row else None


def class_of(symbols: DataFrame, name: str) -> DataFrame:
    """The class of that name, the first by id."""
    return symbols.filter((F.col("name") == name) & (F.col("symbol_type") == "class")).orderBy("id").limit(1)


def ancestry(symbols: DataFrame, class_name: str, most: int | None = None) -> list[str]:
    """Base classes of a class as they are written, breadth first, each once; all of them, or ``most``."""
    level = [b for r in class_of(symbols, class_name).select("bases").collect() for b in r.bases]
    seen: dict[str, None] = {}
    while level and (most is None or len(seen) < most):  # one query for each level
        fresh = [b for b in dict.fromkeys(level) if b not in seen]
        seen |= dict.fromkeys(fresh)
        asked = symbols.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(b.rsplit(".", 1)[-1] for b in fresh)], "name string")
        classes = symbols.filter(F.col("symbol_type") == "class").join(F.broadcast(asked), "name", "left_semi").groupBy("name").agg(F.min_by("bases", "id").alias("bases"))
        bases = {r.name: r.bases for r in classes.collect()}
        level = [x for b in fresh for x in bases.get(b.rsplit(".", 1)[-1], [])]
    return list(seen)[:most]


def inherited(symbols: DataFrame, query: str, limit: int) -> DataFrame | None:
    """What ``Class.member`` names, in the class itself (by qualified name) and then in its bases (by nearness, then id).

    None if there is no such class. A symbol may come once for itself and again for a base.
    """
    if "." not in query:
        return None
    owner, member = query.rsplit(".", 1)
    owner = owner.rsplit(".", 1)[-1]
    # All that is looked at below, so that the catalogue itself is read once.
    near = symbols.filter((F.col("symbol_type") == "class") | like("name", f"%{member}%")).cache()
    if class_of(near, owner).isEmpty():
        near.unpersist()
        return None
    named = near.filter(like("name", f"%{member}%"))
    patterns = [f"%{owner}.{member}%", *[f"%.{base.rsplit('.', 1)[-1]}.{member}%" for base in ancestry(near, owner)]]
    turns = F.array_compact(F.array(*[F.when(like("qualified_name", p), F.lit(i)) for i, p in enumerate(patterns)]))
    out = named.withColumn("turn", F.explode(turns)).withColumn("within", F.when(F.col("turn") == 0, F.col("qualified_name")).otherwise(F.lit("")))
    return out.orderBy("turn", "within", "id").limit(limit)


def closure(edges: DataFrame, start: str, most: int | None = None) -> DataFrame:
    """(class_name, level) of the ancestors of a class over edges (class_name, base_name), by the least number of steps; all of them, or those within ``most`` levels.

    Steps double: the table of what lies within n steps of each class gives what lies within 2 n by one
    join with itself, so a chain of a thousand levels takes ten rounds, and no name passes the driver.
    That table has a row for each class and each of its ancestors, which is small as long as hierarchies
    are not deep and broad at once.
    """
    store = scratch(edges.sparkSession, "closure")
    step = edges.select("class_name", "base_name").distinct().withColumn("level", F.lit(1))
    step = store.table("steps-0", lambda: step)
    found = store.table("found-0", lambda: step.filter(F.col("class_name") == start).select(F.col("base_name").alias("class_name"), "level"))
    turn, n = 0, found.count()
    while n:
        turn += 1
        least = F.min("level").alias("level")
        far = found.join(step.withColumnRenamed("level", "more"), "class_name").select(F.col("base_name").alias("class_name"), (F.col("level") + F.col("more")).alias("level"))
        grown = store.table(f"found-{turn}", lambda f=found, g=far: f.unionByName(g).groupBy("class_name").agg(least))
        m = grown.count()
        found = grown
        if m == n or (most is not None and 2**turn >= most):
            break
        n = m
        middle = step.select(F.col("class_name").alias("base_name"), F.col("base_name").alias("last"), F.col("level").alias("more"))
        twice = step.join(middle, "base_name").select("class_name", F.col("last").alias("base_name"), (F.col("level") + F.col("more")).alias("level"))
        step = store.table(f"steps-{turn}", lambda s=step, t=twice: s.unionByName(t).groupBy("class_name", "base_name").agg(least))
    return found if most is None else found.filter(F.col("level") <= most)
