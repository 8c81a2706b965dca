"""Provenance graphs as edge lists: upserts, closure, linear chains and export in the PROV-JSON form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels that a closure takes one by one before it doubles its steps.
LEVELS = 4


def cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints")
    return df.checkpoint()


def upsert(have: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or ignore: rows whose key is there already, or came before, change nothing."""
    fresh = new.join(have.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return have.unionByName(fresh)


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node, origin and depth (least number of steps) of all that starts (node) derive from; edges: child, parent.

    The first LEVELS levels go one by one, new nodes only, as most graphs are no deeper. What lies beyond is found by doubling: with
    the pairs that are 2^k steps apart, all that is known within 2^k - 1 steps gives all within 2^(k+1) - 1, so a chain
    of any length takes as many rounds as its length has binary digits; the end is when a round finds nothing new, which
    cycles come to as well. Each round is stored on shared storage once. Null nodes are nowhere.
    """
    edges = cut(edges.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL").distinct())
    first = starts.select("node").where("node IS NOT NULL").distinct()
    seen = front = cut(first.select(F.col("node").alias("origin"), "node", F.lit(0).alias("depth")))
    for depth in range(1, LEVELS + 1):
        step = front.join(edges, front["node"] == edges["child"]).select("origin", F.col("parent").alias("node")).distinct()
        front = cut(step.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)  # each level is stored once, by itself
    beyond = _doubled(edges, front.select("node").distinct())
    via = front.join(beyond.select(F.col("origin").alias("node"), F.col("node").alias("to"), F.col("depth").alias("more")), "node")
    all_ = seen.unionByName(via.select("origin", F.col("to").alias("node"), (F.col("depth") + F.col("more")).alias("depth")))
    return all_.groupBy("origin", "node").agg(F.min("depth").alias("depth"))


def _doubled(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """origin, node and depth of all that starts (node) lead to, by pairs that are 1, 2, 4, ... steps apart."""
    known = cut(starts.select(F.col("node").alias("origin"), "node", F.lit(0).alias("depth")))
    n, apart, steps = known.count(), edges, 1
    while True:
        onward = known.join(apart, known["node"] == apart["child"]).select("origin", F.col("parent").alias("node"), (F.col("depth") + steps).alias("depth"))
        known = cut(known.unionByName(onward).groupBy("origin", "node").agg(F.min("depth").alias("depth")))
        before, n = n, known.count()
        if n == before:
            return known
        a, b = apart.alias("a"), apart.alias("b")
        apart = cut(a.join(b, F.col("a.parent") == F.col("b.child")).select("a.child", "b.parent").distinct())
        steps *= 2


def relations(generated: DataFrame, used: DataFrame, derived: DataFrame) -> DataFrame:
    """child and parent over both kinds of edges, nodes as structs (kind, id): an entity comes from the activity that generated it, which
    comes from what it used, and from what it was derived from. Activities stay nodes, so one with many inputs and outputs
    makes no pairs of these."""
    edge = lambda df, kinds, ids: df.select(*[F.struct(F.lit(k).alias("kind"), F.col(i).cast("string").alias("id")).alias(n) for k, i, n in zip(kinds, ids, ("child", "parent"), strict=True)], F.col(ids[0]).isNotNull().alias("_a"), F.col(ids[1]).isNotNull().alias("_b"))
    both = [edge(generated, ("entity", "activity"), ("entity", "activity")), edge(used, ("activity", "entity"), ("activity", "entity")), edge(derived, ("entity", "entity"), ("entity", "source"))]
    return reduce(DataFrame.unionByName, both).where("_a AND _b").select("child", "parent").distinct()


def closure(starts: DataFrame, generated: DataFrame, used: DataFrame, derived: DataFrame, associated: DataFrame) -> DataFrame:
    """origin, kind (entity, activity or agent), id and depth: all that entities starts (node) come from.

    generated: entity, activity; used: activity, entity; derived: entity, source; associated: activity, agent. depth is the least number of
    relations to it, an agent's one more than its activity's. An entity that no relation names is its own closure. No depth is
    too great and cycles end (see ancestors).
    """
    node = F.struct(F.lit("entity").alias("kind"), F.col("node").cast("string").alias("id"))
    # Agents are nodes that nothing leads on from, so the closure finds them on its way and is not stored to be joined again.
    agent = lambda c, kind: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id"))
    does = associated.where("activity IS NOT NULL AND agent IS NOT NULL").select(agent("activity", "activity").alias("child"), agent("agent", "agent").alias("parent"))
    found = ancestors(relations(generated, used, derived).unionByName(does), starts.where("node IS NOT NULL").select(node.alias("node")))
    return found.select(F.col("origin.id").alias("origin"), F.col("node.kind").alias("kind"), F.col("node.id").alias("id"), "depth")


def next_hops(generated: DataFrame, activities: DataFrame, used: DataFrame, derived: DataFrame, revisions: DataFrame) -> DataFrame:
    """entity, activity and next: the newest activity that made it, then its predecessor, else the least source it
    was derived from there, else the first that was used by role. Without an activity only the predecessor counts."""
    made = generated.join(activities, "activity")
    newest = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("started_at"), F.desc("activity")))
    made = made.withColumn("_r", newest).where("_r = 1").select("entity", "activity")
    was = revisions.groupBy("entity").agg(F.min("previous").alias("_previous"))
    source = derived.groupBy("entity", "activity").agg(F.min("source").alias("_source"))
    tool = used.groupBy("activity").agg(F.min_by("entity", F.struct("role", "entity")).alias("_used"))
    out = made.join(was, "entity", "full_outer").join(source, ["entity", "activity"], "left").join(tool, "activity", "left")
    return out.select("entity", "activity", F.coalesce("_previous", "_source", "_used").alias("next"))


def chain(hops: DataFrame, starts: DataFrame, associated: DataFrame | None = None, used: DataFrame | None = None) -> DataFrame:
    """origin, step, entity, activity along next until it ends or comes back to an entity it has seen, however long.

    With associated (activity, agent, kind) and used (activity, entity, role) also agents, by kind and name, and used, by role,
    of each step's activity; empty where it has none.
    """
    first = starts.select(F.col("node").alias("origin"), F.col("node").alias("entity")).distinct()
    now = cut(first.join(hops, "entity", "left").withColumn("step", F.lit(0)).withColumn("_seen", F.array("entity")))
    out = [now]
    while True:
        onward = now.where(F.col("next").isNotNull() & ~F.array_contains("_seen", F.col("next")))
        onward = onward.select("origin", F.col("next").alias("entity"), F.concat("_seen", F.array("next")).alias("_seen"))
        now = cut(onward.join(hops, "entity", "left").withColumn("step", F.lit(len(out))))
        if now.isEmpty():
            break
        out.append(now)
    steps = reduce(DataFrame.unionByName, out).select("origin", "step", "entity", "activity")
    for rows, name, order in ((associated, "agents", ("kind", "agent")), (used, "used", ("role", "entity"))):
        if rows is not None:
            each = F.array_sort(F.collect_list(F.struct(*order)))
            of = rows.groupBy("activity").agg(each.alias("_each")).select("activity", F.col(f"_each.{order[1]}").alias(name))
            steps = steps.join(of, "activity", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return steps.select("origin", "step", "entity", "activity", *(n for n, r in (("agents", associated), ("used", used)) if r is not None))


def prov_json(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: entities, activities and agents by id, and relations by kind, of a closure.

    nodes: kind, id, label. relations: kind, subject, object, is_revision. Relations with an end outside go.
    """
    inside = nodes.select("id").distinct()
    r = relations.join(inside.withColumnRenamed("id", "subject"), "subject", "left_semi").join(inside.withColumnRenamed("id", "object"), "object", "left_semi")
    by_kind = nodes.groupBy("kind").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("id", F.struct("label").alias("v"))))).alias("m"))
    rel = r.groupBy("kind").agg(F.array_sort(F.collect_set(F.struct("subject", "object", "is_revision"))).alias("m"))
    by_name = lambda x, y: F.when(x["kind"] < y["kind"], -1).when(x["kind"] > y["kind"], 1).otherwise(0)
    a = by_kind.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "m")), by_name)).alias("nodes"))
    b = rel.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "m")), by_name)).alias("relations"))
    return a.select("nodes", b.scalar().alias("relations")).select(F.to_json(F.struct("nodes", "relations")).alias("prov"))


def orphans(rows: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """Rows that nothing says the making of."""
    return rows.join(made.select(key).distinct(), key, "left_anti")


#: Sections of a PROV-JSON document in their order, and the type of a name.
SECTIONS = ("entity", "activity", "agent", "used", "wasGeneratedBy", "wasDerivedFrom", "wasAssociatedWith")
NAME_TYPE = "prov:QUALIFIED_NAME"


def _quoted(c: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(c.alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _object(pairs: Column) -> Column:
    """A JSON object of an array of (key, value as JSON); null values have no entry."""
    given = F.filter(pairs, lambda p: p["v"].isNotNull())
    return F.concat(F.lit("{"), F.array_join(F.transform(given, lambda p: F.concat(_quoted(p["k"]), F.lit(":"), p["v"])), ","), F.lit("}"))


def _entry(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("k"), value.alias("v"))


def _typed(type_: Column) -> Column:
    return F.when(type_.isNotNull(), _object(F.array(_entry("$", _quoted(type_)), _entry("type", _quoted(F.lit(NAME_TYPE))))))


def _attributes(attrs: Column, prefix: str) -> Column:
    """Entries of a JSON object's own: names without a prefix get this one, numbers, texts and truth values stay, all else becomes its JSON text."""
    one = F.map_entries(F.from_json(attrs, "map<string,variant>"))

    def entry(e):
        text = F.to_json(e["value"])
        plain = F.schema_of_variant(e["value"]).rlike("^(STRING|BIGINT|DOUBLE|DECIMAL|BOOLEAN|FLOAT|INT)")
        key = F.when(F.contains(e["key"], F.lit(":")), e["key"]).otherwise(F.concat(F.lit(prefix + ":"), e["key"]))
        return F.struct(key.alias("k"), F.when(plain, text).otherwise(_quoted(F.coalesce(text, F.lit("null")))).alias("v"))

    return F.coalesce(F.transform(one, entry), F.array().cast("array<struct<k:string,v:string>>"))


def prov_document(closed: DataFrame, entities: DataFrame, activities: DataFrame, agents: DataFrame, generated: DataFrame, used: DataFrame, derived: DataFrame, associated: DataFrame, revisions: DataFrame, prefix: str = "ql", namespace: str = "urn:quarterlight:") -> DataFrame:
    """origin and prov: each closure as one document in the PROV-JSON form.

    closed: what closure() gives. entities, activities, agents: id, type, label, attrs (a JSON object), activities also started_at and
    ended_at; generated: entity, activity; used: activity, entity, role; derived: entity, source, activity; associated: activity, agent,
    role; revisions: entity, previous. Nodes without a row of their own are not described, relations with an end
    outside the closure go, and a derivation that is a revision says so. Relations are numbered in their order by kind and
    ends; empty sections are left out. A document is one row, as large as its closure.
    """
    nodes = closed.select("origin", "kind", "id").distinct()
    of = lambda kind, name: nodes.where(F.col("kind") == kind).select("origin", F.col("id").alias(name))
    parts = []
    for kind, rows in (("entity", entities), ("activity", activities), ("agent", agents)):
        times = [_entry(k, F.when(F.col(c) != "", _quoted(F.col(c)))) for k, c in (("prov:startTime", "started_at"), ("prov:endTime", "ended_at")) if kind == "activity"]
        told = F.concat(F.array(_entry("prov:type", _typed(F.col("type"))), _entry("prov:label", F.when(F.col("label") != "", _quoted(F.col("label"))))), _attributes(F.col("attrs"), prefix), F.array(*times) if times else F.array().cast("array<struct<k:string,v:string>>"))
        parts.append(of(kind, "id").join(rows.dropDuplicates(["id"]), "id").select("origin", F.lit(kind).alias("section"), F.array(F.col("id")).alias("key"), F.col("id").alias("name"), _object(told).alias("json")))
    quote = lambda k, c: _entry(k, F.when(F.col(c) != "", _quoted(F.col(c))))
    made = generated.distinct().join(of("entity", "entity"), "entity").join(of("activity", "activity"), ["origin", "activity"])
    took = used.distinct().join(of("activity", "activity"), "activity").join(of("entity", "entity"), ["origin", "entity"])
    does = associated.distinct().join(of("activity", "activity"), "activity")
    again = revisions.select("entity", F.col("previous").alias("source")).distinct().withColumn("_revision", F.lit("prov:Revision"))
    came = derived.distinct().join(of("entity", "entity"), "entity").join(of("entity", "source"), ["origin", "source"]).join(again, ["entity", "source"], "left")
    inside = of("activity", "activity").withColumn("_in", F.lit(True))
    came = came.join(inside, ["origin", "activity"], "left").withColumn("activity", F.when(F.col("_in"), F.col("activity")))
    for section, rows, ends, entries in (
        ("used", took, ("activity", "entity", "role"), (quote("prov:activity", "activity"), quote("prov:entity", "entity"), quote("prov:role", "role"))),
        ("wasAssociatedWith", does, ("activity", "agent", "role"), (quote("prov:activity", "activity"), quote("prov:agent", "agent"), quote("prov:role", "role"))),
        ("wasGeneratedBy", made, ("entity", "activity"), (quote("prov:entity", "entity"), quote("prov:activity", "activity"))),
        ("wasDerivedFrom", came, ("entity", "source", "activity"), (quote("prov:generatedEntity", "entity"), quote("prov:usedEntity", "source"), quote("prov:activity", "activity"), _entry("prov:type", _typed(F.col("_revision"))))),
    ):
        parts.append(rows.select("origin", F.lit(section).alias("section"), F.array(*ends).alias("key"), F.lit(None).cast("string").alias("name"), _object(F.array(*entries)).alias("json")))
    all_ = reduce(DataFrame.unionByName, parts)
    place = F.when(F.col("name").isNull(), F.row_number().over(Window.partitionBy("origin", F.col("name").isNull()).orderBy("section", "key")))
    one = F.struct(F.coalesce(F.lpad(place.cast("string"), 12, "0"), F.lit("")).alias("at"), F.coalesce("name", F.concat(F.lit("_:r"), place.cast("string"))).alias("k"), F.col("json").alias("v"))
    placed = all_.withColumn("_one", one)
    by_section = placed.groupBy("origin", "section").agg(F.sort_array(F.collect_list("_one")).alias("_all"))
    whole = by_section.groupBy("origin").agg(F.map_from_entries(F.collect_list(F.struct("section", _object(F.col("_all"))))).alias("m"))
    head = _entry("prefix", F.lit(f'{{"{prefix}":"{namespace}","xsd":"http://www.w3.org/2001/XMLSchema#"}}'))
    return whole.select("origin", _object(F.array(head, *[_entry(s, F.col("m")[s]) for s in SECTIONS])).alias("prov"))
