"""Type search: constructor dictionary, fingerprints, coarse candidates, unification, ranking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vireo.functions.signatures import Sig, Ty, from_preorder, preorder
from vireo.operators.relations import BROADCAST_ROWS, small
from vireo.session import written

FIRST_CON, TOP = 100, (1 << 32) - 1
COMMON = 1024
CANDIDATES, RESULTS = 5000, 100
#: Queries of a batch that are broadcast together, and pairs that one task makes, about.
BLOCK, PAIRS = 10_000, 20_000_000
NODE = "array<struct<tag:string,name:bigint,nargs:int>>"
CTX = "array<struct<cls:bigint,var:bigint>>"
NAMED_NODE = "array<struct<tag:string,name:string,nargs:int>>"
NAMED_CTX = "array<struct<cls:string,var:string>>"


# dictionary


def _constructors() -> Column:
    """The names of a signature that the dictionary numbers: classes marked by ~, and constructors."""
    return F.concat(F.transform("ctx", lambda c: F.concat(F.lit("~"), c["cls"])), F.transform(F.filter("tree", lambda n: n["tag"] == "con"), lambda n: n["name"]))


def outline(sigs: DataFrame) -> DataFrame:
    """(sig_ord, cons, arity, terms): a signature's distinct constructors and what else its fingerprint needs, in one pass."""
    arity = F.least(F.lit(255), F.greatest(F.lit(0), F.col("n_types") - 1)).cast("int")
    terms = F.least(F.lit(255), F.size("tree") + 2 * F.size("ctx")).cast("int")
    return sigs.select("sig_ord", F.array_distinct(_constructors()).alias("cons"), arity.alias("arity"), terms.alias("terms"))


def constructor_uses(sigs: DataFrame) -> DataFrame:
    """(name, uses): in how many signatures (or outlines) each constructor, and each class marked by ~, occurs."""
    cons = F.col("cons") if "cons" in sigs.columns else F.array_distinct(_constructors())
    return sigs.select(F.explode(cons).alias("name")).groupBy("name").agg(F.count("*").alias("uses"))


def instance_counts(instances: DataFrame) -> DataFrame:
    """(name, instances): instances per class, of those with exactly one type that is a constructor."""
    return instances.where((F.col("n_types") == 1) & (F.col("tree")[0]["tag"] == "con")).groupBy(F.concat(F.lit("~"), F.col("tree")[0]["name"]).alias("name")).agg(F.count("*").alias("instances"))


def constructor_frequency(sigs: DataFrame, instances: DataFrame | None = None) -> DataFrame:
    """(name, freq): uses, and for classes with instances the smaller of uses and instances once more; classes that only
    have instances count those."""
    uses = constructor_uses(sigs)
    if instances is None:
        return uses.select("name", F.col("uses").alias("freq"))
    both = uses.join(instance_counts(instances), "name", "full_outer")
    freq = F.when(F.col("uses").isNull(), F.col("instances")).otherwise(F.col("uses") + F.coalesce(F.least("uses", "instances"), F.lit(0)))
    return both.select("name", freq.alias("freq"))


def spread_names(freq: DataFrame) -> DataFrame:
    """(name, id, freq): unique descending ids over the 32-bit range, by interpolation of clipped counts. Each id depends
    on the one before, so one task folds over the sorted dictionary, batch by batch, and its result is written. The
    dictionary holds names, not rows; the sort spills, and the fold keeps three numbers."""
    freq = written(freq, "frequencies")
    n, most = freq.agg(F.count("*"), F.max("freq")).first()
    limit = float(min(COMMON, most or 1))

    def fold(batches):
        low, high = 99 + n, TOP
        for b in batches:
            ids = []
            for count in b.column("freq").to_pylist():
                ideal = low + int(float(min(COMMON, count)) * float(high - low) / limit)
                ids.append(max(low, min(high, ideal)))
                low, high = low - 1, ids[-1] - 1
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(ids, pa.int64()), b.column("freq")], ["name", "id", "freq"])

    rows = freq.select("name", F.col("freq").cast("bigint").alias("freq")).repartition(1).sortWithinPartitions(F.desc("freq"), "name")
    return written(rows.mapInArrow(fold, "name string, id bigint, freq bigint"), "dictionary")


# encoding


def encode(sigs: DataFrame, names: DataFrame, broadcast_names: int = BROADCAST_ROWS) -> DataFrame:
    """Names to numbers: constructors by the dictionary (unknown ones 0), variables by first occurrence after ``_``,
    contexts before terms, at most 99. The dictionary is broadcast only while it is small; ``sig_ord`` identifies rows."""
    vars_ = F.array_distinct(F.concat(F.array(F.lit("_")), F.transform("ctx", lambda c: c["var"]), F.transform(F.filter("tree", lambda n: n["tag"] == "var"), lambda n: n["name"])))
    s = sigs.withColumn("_vars", vars_)
    wanted = s.select("sig_ord", F.explode(F.array_distinct(_constructors())).alias("name"))
    found = wanted.join(small(names.select("name", "id"), broadcast_names), "name").groupBy("sig_ord").agg(F.map_from_entries(F.collect_list(F.struct("name", "id"))).alias("_ids"))
    s = s.join(found, "sig_ord", "left").withColumn("_ids", F.coalesce("_ids", F.create_map().cast("map<string,bigint>")))
    number = lambda x: F.least(F.lit(99), F.array_position("_vars", x) - 1).cast("bigint")
    con = lambda x: F.coalesce(F.try_element_at("_ids", x), F.lit(0)).cast("bigint")
    ctx = F.transform("ctx", lambda c: F.struct(con(F.concat(F.lit("~"), c["cls"])).alias("cls"), number(c["var"]).alias("var")))
    tree = F.transform("tree", lambda n: F.struct(n["tag"].alias("tag"), F.when(n["tag"] == "con", con(n["name"])).otherwise(number(n["name"])).alias("name"), n["nargs"].alias("nargs")))
    return s.withColumns({"ctx": ctx, "tree": tree}).drop("_vars", "_ids")


def encode_query(sig: Sig, ids: dict[str, int]) -> Sig:
    """A query's signature with numbers for names."""
    vars_ = list(dict.fromkeys(["_", *(v for _, v in sig.ctx), *(name for tag, name, _ in preorder(sig.types) if tag == "var")]))
    var = lambda v: min(99, vars_.index(v))

    def term(t: Ty) -> Ty:
        return Ty(t.tag, ids.get(t.name, 0) if t.tag == "con" else var(t.name), tuple(map(term, t.args)))

    return Sig(tuple((ids.get("~" + c, 0), var(v)) for c, v in sig.ctx), tuple(map(term, sig.types)))


# fingerprints


def fingerprint(ctx: Column, tree: Column, n_types: Column) -> Column:
    """struct(rare: the three smallest constructor ids, padded by 0; arity; terms)"""
    names = F.concat(F.transform(tree, lambda n: n["name"]), F.flatten(F.transform(ctx, lambda c: F.array(c["cls"], c["var"]))))
    rare = F.slice(F.array_sort(F.array_distinct(F.filter(names, lambda x: x >= FIRST_CON))), 1, 3)
    rare = F.slice(F.concat(rare, F.array_repeat(F.lit(0).cast("bigint"), 3)), 1, 3)
    return F.struct(rare.alias("rare"), F.least(F.lit(255), F.greatest(F.lit(0), n_types - 1)).cast("int").alias("arity"), F.least(F.lit(255), F.size(names)).cast("int").alias("terms"))


def fingerprints(outlines: DataFrame, names: DataFrame, broadcast_names: int = BROADCAST_ROWS) -> DataFrame:
    """The same (sig_ord, fp) without encoding: only a signature's distinct constructors meet the dictionary, so that very long
    signatures cost no more than their length."""
    wanted = outlines.select("sig_ord", F.explode("cons").alias("name"))
    found = wanted.join(small(names.select("name", "id"), broadcast_names), "name").groupBy("sig_ord").agg(F.slice(F.array_sort(F.collect_set("id")), 1, 3).alias("_rare"))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), 3)
    rare = F.slice(F.concat(F.coalesce("_rare", F.array().cast("array<bigint>")), zeros), 1, 3)
    return outlines.join(found, "sig_ord", "left").select("sig_ord", F.struct(rare.alias("rare"), "arity", "terms").alias("fp"))


def query_fingerprint(s: Sig) -> tuple[list[int], int, int]:
    names = [n for _, n, _ in preorder(s.types)] + [x for c in s.ctx for x in c]
    rare = sorted({n for n in names if n >= FIRST_CON})[:3]
    return rare + [0] * (3 - len(rare)), min(255, max(0, len(s.types) - 1)), min(255, len(names))


def popularity(id_: Column) -> Column:
    return (id_ - FIRST_CON).cast("double") / float(TOP - FIRST_CON)


def _cost(n: Column, rare: int, common: int) -> Column:
    return F.floor(popularity(n) * F.lit(float(common)) + (F.lit(1.0) - popularity(n)) * F.lit(float(rare))).cast("bigint")


def missing_cost(n: Column) -> Column:
    """Of a constructor of the query that the candidate lacks."""
    return _cost(n, 5000, 400)


def added_cost(n: Column) -> Column:
    """Of a constructor of the candidate that the query lacks."""
    return _cost(n, 1000, 50)


def _difference(want: Column, have: Column, cost) -> Column:
    each = F.transform(want, lambda n: F.when(F.array_contains(have, n) | (n == 0), F.lit(0).cast("bigint")).otherwise(cost(n)))
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x)


def shape_cost(q_arity: Column, q_terms: Column, q_any: Column, arity: Column, terms: Column) -> dict[str, Column]:
    """What arities and numbers of terms cost; null is a miss."""
    more = arity - q_arity
    by_arity = (
        F.when((q_arity == 0) | (arity == 0), F.when((q_arity == 0) & (arity == 0), 0))
        .when(more == 0, 0)
        .when(more == -1, 1000)
        .when((more > 0) & q_any, more * 300)
        .when(more == 1, 300)
        .when(more == 2, 900)
    )
    extra = terms - q_terms
    by_terms = F.when(F.abs(extra) > 20, None).when(extra >= 0, extra * 10).otherwise(-extra * 12)
    return {"arity_cost": by_arity, "terms_cost": by_terms}


def cost_terms(q_rare: Column, q_arity: Column, q_terms: Column, q_any: Column, fp: Column) -> dict[str, Column]:
    """The parts of the fingerprint cost of candidates; null is a miss."""
    parts = shape_cost(q_arity, q_terms, q_any, fp["arity"], fp["terms"])
    return parts | {"missing_cost": _difference(q_rare, fp["rare"], missing_cost), "added_cost": _difference(fp["rare"], q_rare, added_cost)}


def query_cost(s: Sig, fp: Column) -> dict[str, Column]:
    rare, arity, terms = query_fingerprint(s)
    any_ = any(t == Ty("var", 0) for t in s.types)
    return cost_terms(F.array(*[F.lit(x).cast("bigint") for x in rare]), F.lit(arity), F.lit(terms), F.lit(any_), fp)


def total_cost(parts: dict[str, Column]) -> Column:
    total = None
    for c in parts.values():
        total = c if total is None else total + c
    return total.cast("bigint")


def coarse(sigs: DataFrame, s: Sig, n: int = CANDIDATES) -> DataFrame:
    """The n candidates of least fingerprint cost, ties in index order."""
    fp = F.col("fp") if "fp" in sigs.columns else fingerprint(F.col("ctx"), F.col("tree"), F.col("n_types"))
    found = sigs.withColumn("fp_cost", total_cost(query_cost(s, fp))).where("fp_cost is not null")
    return found.orderBy("fp_cost", "sig_ord").limit(n)


def _shape(fp: Column, any_: Column | None = None) -> Column:
    """Arity and terms as one number, and whether anything matches."""
    both = fp["arity"] * 256 + fp["terms"]
    return both if any_ is None else both * 2 + any_.cast("int")


def _shapes(sigs: DataFrame, queries: DataFrame) -> DataFrame:
    """(want, have, shape_cost): the shapes of queries with those of signatures that they can match. Shapes are few."""
    want = queries.select(_shape(F.col("q"), F.col("any_")).alias("want"), F.col("q.arity").alias("qa"), F.col("q.terms").alias("qt"), "any_").distinct()
    have = sigs.select(_shape(F.col("fp")).alias("have"), "fp.arity", "fp.terms").distinct()
    cost = total_cost(shape_cost(F.col("qa"), F.col("qt"), F.col("any_"), F.col("arity"), F.col("terms")))
    return written(want.join(F.broadcast(have)).select("want", "have", cost.alias("shape_cost")).where("shape_cost is not null"), "shapes")


def _flat(fp: str, cost, id_: str, of: str) -> list[Column]:
    """The three constructors of a fingerprint and their costs as columns, so that a pair is compared without arrays."""
    ids = [F.col(f"{fp}.rare")[k] for k in range(3)]
    return [c for k, n in enumerate(ids) for c in (n.alias(f"{id_}{k}"), F.when(n == 0, 0).otherwise(cost(n)).cast("bigint").alias(f"{of}{k}"))]


def _all_pairs(sigs: DataFrame, queries: DataFrame, shapes: DataFrame, block: int) -> DataFrame:
    """Every signature with every query of a shape that matches. The pairs may be as many as the product of both, so signatures
    are spread over tasks by that; a task holds a block of queries and streams its signatures."""
    n = queries.count()
    blocks = max(1, -(-n // block))
    tasks = max(int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sigs.count() * n // (blocks * PAIRS)))
    have = sigs.select("sig_ord", "fp", _shape(F.col("fp")).alias("have"), *_flat("fp", added_cost, "c", "added")).repartition(tasks, "sig_ord").join(small(shapes), "have")
    want = queries.select("query_id", _shape(F.col("q"), F.col("any_")).alias("want"), *_flat("q", missing_cost, "q", "missing"))
    if blocks > 1:
        want = written(want, "queries")
    cost = F.col("shape_cost")
    for k in range(3):
        for one, other, of in (("q", "c", "missing"), ("c", "q", "added")):
            shared = (F.col(f"{one}{k}") == F.col(f"{other}0")) | (F.col(f"{one}{k}") == F.col(f"{other}1")) | (F.col(f"{one}{k}") == F.col(f"{other}2"))
            cost = cost + F.when(shared, 0).otherwise(F.col(f"{of}{k}"))
    found = None
    for k in range(blocks):
        q = want.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) if blocks > 1 else want
        pairs = have.join(F.broadcast(q), "want").select("sig_ord", "fp", "query_id", cost.alias("fp_cost"))
        found = pairs if found is None else found.unionByName(pairs)
    return found


def _subsets(rare: Column) -> Column:
    """All sets of a fingerprint's constructors, the empty one too."""
    some = F.filter(rare, lambda n: n != 0)
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda m: F.filter(some, lambda n, i: F.getbit(m, i) == 1))


def _best(sigs: DataFrame, queries: DataFrame, shapes: DataFrame, n: int) -> DataFrame:
    """Of each query its n best, without a look at all pairs. Take the candidates of one shape that hold a set S of
    constructors: next to a query that shares S with them and nothing else, they differ by what their other constructors add
    alone, and nothing shared makes one dearer. So the n of the least such sums, ties in index order, hold all of that shape that
    share S with a query and are among its n best; a query looks up the sets of its own constructors."""
    other = lambda c, s: F.aggregate(F.transform(F.array_except(F.filter(c, lambda x: x != 0), s), added_cost), F.lit(0).cast("bigint"), lambda a, x: a + x)
    sets = lambda fp: F.explode(F.array_distinct(_subsets(F.col(f"{fp}.rare")))).alias("shared")
    least = F.row_number().over(Window.partitionBy("have", "shared").orderBy("sum", F.asc_nulls_last("sig_ord")))
    have = sigs.select("sig_ord", "fp", _shape(F.col("fp")).alias("have"), sets("fp")).withColumn("sum", other(F.col("fp.rare"), F.col("shared")))
    have = have.withColumn("least", least).where(F.col("least") <= n).drop("least", "sum")
    want = queries.withColumn("want", _shape(F.col("q"), F.col("any_"))).select("query_id", "q", "want", sets("q")).join(small(shapes), "want")
    pairs = have.join(want, ["have", "shared"])
    pairs = pairs.where(F.size(F.array_intersect(F.filter("q.rare", lambda x: x != 0), F.col("fp.rare"))) == F.size("shared"))  # exactly these
    cost = F.col("shape_cost") + _difference(F.col("q.rare"), F.col("fp.rare"), missing_cost) + _difference(F.col("fp.rare"), F.col("q.rare"), added_cost)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("fp_cost", F.asc_nulls_last("sig_ord")))
    return pairs.select("sig_ord", "fp", "query_id", cost.alias("fp_cost")).withColumn("rank", rank).where(F.col("rank") <= n)


def coarse_batch(sigs: DataFrame, queries: DataFrame, n: int | None = CANDIDATES, block: int = BLOCK) -> DataFrame:
    """Candidates (sig_ord, fp) of many queries (query_id, fp, any_var) at once, with their cost; of each query the n best with
    their rank, or with no n all of them without, whose number is that of all pairs of like shape."""
    sigs = sigs.select("sig_ord", "fp")
    queries = queries.select("query_id", F.col("fp").alias("q"), F.col("any_var").alias("any_"))
    shapes = _shapes(sigs, queries)
    return _all_pairs(sigs, queries, shapes, block) if n is None else _best(sigs, queries, shapes, n)


def explain(sigs: DataFrame, s: Sig) -> DataFrame:
    """Every signature with its fingerprint and the parts of its cost, misses included."""
    fp = fingerprint(F.col("ctx"), F.col("tree"), F.col("n_types"))
    parts = query_cost(s, F.col("fp"))
    return sigs.withColumn("fp", fp).withColumns(parts).withColumn("fp_cost", total_cost(parts))


# unification


def _node(t: Ty, arrow: int):
    if t.tag == "con" and t.name == arrow and t.args:
        return ("fun", 0, tuple(_node(a, arrow) for a in t.args))
    return (t.tag, t.name, tuple(_node(a, arrow) for a in t.args))


def unify(query: Sig, answer: Sig, arrow: int) -> int | None:
    """The work of making the answer match, or None. Only names of the answer can be bound; results come before
    arguments; a name bound once stays."""
    bound: dict[int, int] = {}
    touched: set[int] = set()
    work = 0

    def name(q: int, a: int) -> bool:
        nonlocal work
        if a in bound:
            return bound[a] == q
        if a >= FIRST_CON:
            if a != q:
                return False
            if q not in touched:
                return True
        bound[a] = q
        touched.add(q)
        work += 1
        return True

    def node(q, a) -> bool:
        if q[0] == "fun" or a[0] == "fun":
            if q[0] != a[0] or len(q[2]) != len(a[2]):
                return False
            order = [*q[2][-1:], *q[2][:-1]], [*a[2][-1:], *a[2][:-1]]
            return all(node(x, y) for x, y in zip(*order))
        if q[0] == "var" and a[0] == "con" or len(q[2]) != len(a[2]):
            return False
        return name(q[1], a[1]) and all(node(x, y) for x, y in zip(q[2], a[2]))

    whole = lambda s: ("fun", 0, tuple(_node(t, arrow) for t in s.types))
    if not node(whole(query), whole(answer)):
        return None
    left = {(bound.get(c, c), bound.get(v, v)) for c, v in answer.ctx} - set(query.ctx)
    return work + 3 * sum(v < FIRST_CON for _, v in left)


def _matches(variants: list[tuple[int, Sig]], arrow: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for sig_ord, fp_cost, ctx, tree in zip(f["sig_ord"], f["fp_cost"], f["ctx"], f["tree"]):
                a = Sig(tuple((c["cls"], c["var"]) for c in ctx), from_preorder((n["tag"], n["name"], n["nargs"]) for n in tree))
                for v, q in variants:
                    work = unify(q, a, arrow)
                    if work is not None:
                        out.append((v, sig_ord, work, fp_cost, 500 * work + fp_cost))
            yield pd.DataFrame(out, columns=["variant", "sig_ord", "work", "fp_cost", "total"])

    return run


def match(candidates: DataFrame, variants: list[tuple[int, Sig]], arrow: int, n: int = RESULTS) -> DataFrame:
    """For each variant its best n candidates by (total, fingerprint cost, order)."""
    found = candidates.select("sig_ord", "fp_cost", "ctx", "tree").mapInPandas(_matches(variants, arrow), "variant int, sig_ord bigint, work bigint, fp_cost bigint, total bigint")
    rank = F.row_number().over(Window.partitionBy("variant").orderBy("total", "fp_cost", "sig_ord"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


def swapped(s: Sig) -> Sig | None:
    return s._replace(types=(s.types[1], s.types[0], s.types[2])) if len(s.types) == 3 else None


def partial(s: Sig, maybe: int) -> Sig | None:
    return s._replace(types=(*s.types[:-1], Ty("con", maybe, (s.types[-1],)))) if s.types else None


def search_types(sigs: DataFrame, targets: DataFrame, sig: Sig, ids: dict[str, int], n: int = RESULTS) -> DataFrame:
    """(rank, item_id, variant, total): the query and its variants, two classes that share a coarse scan each; the second
    class only if the first gives fewer than n. ``targets`` has (sig_ord, pos, item_id)."""
    q = encode_query(sig, ids)
    arrow, maybe = ids.get("->", 0), ids.get("Maybe", 0)
    wrapped = partial(q, maybe)
    classes = [[(0, q), (1, swapped(q))], [(2, wrapped), (3, swapped(wrapped) if wrapped else None)]]
    found = None
    for variants in classes:
        variants = [(v, s) for v, s in variants if s is not None]
        if not variants:
            continue
        best = match(coarse(sigs, variants[0][1]), variants, arrow, n)
        # hits are few (at most n per variant), so they are the broadcast side
        rows = targets.join(small(best), "sig_ord").orderBy("variant", "total", "fp_cost", "sig_ord", "pos").limit(n)
        found = rows if found is None else found.unionByName(rows)
        if variants[0][0] == 0:
            first = found.collect()  # at most n rows
            found = sigs.sparkSession.createDataFrame(first, found.schema)
            if len(first) >= n:
                break
    order = Window.orderBy("variant", "total", "fp_cost", "sig_ord", "pos")  # over at most 2n rows
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("rank", "item_id", "variant", "total")


def duplicates_index(rows: DataFrame, key: list[str], order: str, id_: str) -> DataFrame:
    """Equal signatures once, in order of first occurrence, with the ids that have them in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(id_).alias("i"))))
    return rows.groupBy(*key).agg(F.min(order).alias("first_ord"), F.transform(pairs, lambda p: p["i"]).alias("ids"))
