"""Unification against a literal union-find, dictionary and fingerprint rules, the signature grammar."""

import random

import pytest
from pyspark.sql import functions as F

from vireo.functions.signatures import GrammarError, Sig, Ty, from_preorder, items_of, parse_declaration, parse_type, preorder, pretty, to_signature
from vireo.operators import typesearch as ts

ARROW = 5000


def literal(query, answer):
    """Names as union-find cells with ranks: query cells are fixed, answer variables free."""
    parent, rank, fixed, work = {}, {}, {}, [0]

    def cell(side, name):
        key = (side, name)
        if key not in parent:
            parent[key], rank[key] = key, 0
            fixed[key] = name if side == "q" or name >= ts.FIRST_CON else None
        return key

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    def join(a, b):
        a, b = root(a), root(b)
        if fixed[a] is not None and fixed[b] is not None and fixed[a] != fixed[b]:
            return False
        if (fixed[a], rank[a], a if fixed[a] is None else 0) == (fixed[b], rank[b], b if fixed[b] is None else 0):
            return True
        work[0] += 1
        parent[b] = a  # the query's cell stays root
        if rank[a] <= rank[b]:
            rank[a] = rank[b] + 1
        return True

    def node(q, a):
        if q[0] == "fun" or a[0] == "fun":
            if q[0] != a[0] or len(q[2]) != len(a[2]):
                return False
            pairs = [(q[2][-1], a[2][-1]), *zip(q[2][:-1], a[2][:-1])] if q[2] else []
            return all(node(x, y) for x, y in pairs)
        if (q[0], a[0]) == ("var", "con") or len(q[2]) != len(a[2]):
            return False
        return join(cell("q", q[1]), cell("a", a[1])) and all(node(x, y) for x, y in zip(q[2], a[2]))

    whole = lambda s: ("fun", 0, tuple(ts._node(t, ARROW) for t in s.types))
    return work[0] if node(whole(query), whole(answer)) else None


def random_type(rng, depth):
    if rng.random() < 0.5 or depth == 0:
        return Ty("var", rng.randrange(1, 4)) if rng.random() < 0.6 else Ty("con", rng.choice([100, 101, 102]))
    name, n = rng.choice([(103, 1), (104, 2), (ARROW, 2), (ARROW, 3)])
    return Ty("con", name, tuple(random_type(rng, depth - 1) for _ in range(n)))


def test_unify_equals_union_find():
    rng, matched = random.Random(1), 0
    for _ in range(20_000):
        n = rng.randrange(1, 4)
        q, a = (Sig((), tuple(random_type(rng, 2) for _ in range(n))) for _ in range(2))
        want = literal(q, a)
        got = ts.unify(q, a, ARROW)
        assert (got is None) == (want is None), (q, a)
        matched += want is not None
    assert matched > 1000


@pytest.mark.parametrize(
    "query,answer,work",
    [("a -> b", "a -> b", 2), ("a -> a", "a -> b", 2), ("a -> b", "a -> a", None), ("Int -> Int", "a -> a", 1), ("a -> b", "Int -> b", None), ("[Int]", "[Int]", 0), ("[Int]", "f Int", 1), ("f Int", "[Int]", None), ("a", "a -> b", None)],
)
def test_unify_cases(query, answer, work):
    ids = {"Int": 100, "[]": 101, "->": ARROW}
    enc = lambda t: ts.encode_query(to_signature(parse_type(t)), ids)
    got = ts.unify(enc(query), enc(answer), ARROW)
    assert (got is None) == (work is None) and (work is None or got == work)


def test_dictionary(spark):
    freq = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1), ("d", 40), ("->", 2000)], "name string, freq bigint")
    rows = {r["name"]: r["id"] for r in ts.spread_names(freq).collect()}
    order = sorted(rows, key=lambda n: -rows[n])
    assert order == ["->", "d", "a", "b", "c"] and rows["->"] == ts.TOP and len(set(rows.values())) == 5 and min(rows.values()) >= ts.FIRST_CON
    assert ts.spread_names(freq.limit(0)).count() == 0


def test_large_dictionary_equals_a_fold(spark):
    rng = random.Random(6)
    counts = {f"n{i:05}": int(3000 / (i + 1)) + rng.randrange(1, 3) for i in range(25_000)}
    low, high, want = 99 + len(counts), ts.TOP, {}
    for name in sorted(counts, key=lambda n: (-counts[n], n)):
        real = max(low, min(high, low + int(float(min(1024, counts[name])) * float(high - low) / 1024.0)))
        want[name] = real
        low, high = low - 1, real - 1
    freq = spark.createDataFrame(list(counts.items()), "name string, freq bigint").repartition(5)
    assert {r["name"]: r["id"] for r in ts.spread_names(freq).collect()} == want and len(set(want.values())) == len(want)


def test_fingerprints_equal_those_of_encoded_signatures(spark):
    rng = random.Random(8)
    rows = []
    for i in range(80):
        words = [rng.choice(["x", "y", *(f"c{k}" for k in range(30))]) for _ in range(rng.choice([0, 1, 5, 400]))]
        rows.append((i, [{"cls": "Eq", "var": "x"}] if i % 3 == 0 else [], [{"tag": "var" if len(w) == 1 else "con", "name": w, "nargs": 0} for w in words], len(words)))
    sigs = spark.createDataFrame(rows, f"sig_ord bigint, ctx {ts.NAMED_CTX}, tree {ts.NAMED_NODE}, n_types int")
    dictionary = ts.spread_names(ts.constructor_frequency(sigs).where("name <> 'c7'"))  # one name is unknown
    want = ts.encode(sigs, dictionary).select("sig_ord", ts.fingerprint(F.col("ctx"), F.col("tree"), F.col("n_types")).alias("fp"))
    outlines = ts.outline(sigs)
    assert sorted(map(tuple, ts.constructor_frequency(outlines).collect())) == sorted(map(tuple, ts.constructor_frequency(sigs).collect()))
    fps = ts.fingerprints(outlines, dictionary)
    for limit in (10, 1_000_000):
        assert sorted(map(tuple, ts.fingerprints(outlines, dictionary, limit).collect())) == sorted(map(tuple, want.collect()))
    q = fps.where("sig_ord % 7 = 0").select(F.col("sig_ord").alias("query_id"), "fp", F.lit(False).alias("any_var"))
    for n in (3, None):
        one, many = (sorted(map(tuple, ts.coarse_batch(fps, q, n, block).drop("fp").collect())) for block in (1000, 4))
        assert one == many and len(one) > 20


def test_fingerprints_in_sql_equal_python(spark):
    rng = random.Random(2)
    sigs = [Sig(((100, 1),) if rng.random() < 0.3 else (), tuple(random_type(rng, 2) for _ in range(rng.randrange(1, 5)))) for _ in range(60)]
    rows = [(i, [{"cls": c, "var": v} for c, v in s.ctx], [{"tag": t, "name": n, "nargs": k} for t, n, k in preorder(s.types)], len(s.types)) for i, s in enumerate(sigs)]
    df = spark.createDataFrame(rows, f"sig_ord bigint, ctx {ts.CTX}, tree {ts.NODE}, n_types int")
    fp = df.select("sig_ord", ts.fingerprint(F.col("ctx"), F.col("tree"), F.col("n_types")).alias("f")).collect()
    assert {r["sig_ord"]: (list(r["f"]["rare"]), r["f"]["arity"], r["f"]["terms"]) for r in fp} == {i: tuple(ts.query_fingerprint(s)) for i, s in enumerate(sigs)}
    best = ts.coarse(df, sigs[0], 5).collect()
    whole = ts.explain(df, sigs[0]).where("fp_cost is not null").orderBy("fp_cost", "sig_ord").limit(5).collect()
    assert [r["sig_ord"] for r in best] == [r["sig_ord"] for r in whole]


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("type Path = [Char]", ["alias"]),
        ("data Perhaps a", ["name"]),
        ("Nought :: Perhaps a", ["signature", "name"]),
        ("swap# :: Int# -> b", ["signature", "name"]),
        ("(,,) :: a -> b -> c -> (a, b, c)", ["signature", "name"]),
        ("data (,,) a b c", ["name"]),
        ("() :: ()", ["signature", "name"]),
        ("data Letter :: *", ["name"]),
        ("Step :: !(Perhaps Text) -> {-# UNPACK #-} !Int -> !(Int -> Bool) -> Step", ["signature", "name"]),
        ("both# :: Int# -> (# Int#, Int# #)", ["signature", "name"]),
        ("pattern Shape :: ()", ["name"]),
        ("angle :: Real x => Turn x -> Degree x", ["signature", "name"]),
        ("class Wide a b | a -> b", ["name"]),
        ("instance Eq x => Eq (Degree x)", ["instance"]),
        ("type family Own m a :: * -> *", ["name"]),
        ("data family Kin item :: *", ["name"]),
        ("infixl 4 `with`", []),
        ("free :: (forall m . Monad m => f m -> m a) -> Free f a", ["signature", "name"]),
        ("pick :: Proxy '[] -> Proxy '(a, 3)", ["signature", "name"]),
        ("hop :: (?where :: Place) => a -> a", ["signature", "name"]),
    ],
)
def test_declarations(text, kinds):
    d = parse_declaration(text)
    assert [k for k, *_ in (items_of(d) if d.kind != "fixity" else [])] == kinds


def test_signatures_round_trip():
    for t in ("a -> b", "(a -> b) -> [a] -> [b]", "Ord a => [a] -> Maybe (a,b)", "m (t b)", "(a,b,c)"):
        s = to_signature(parse_type(t))
        assert pretty(s) == t and from_preorder(preorder(s.types)) == s.types and to_signature(parse_type(pretty(s))) == s
    with pytest.raises(GrammarError):
        parse_declaration("this is :: no ->")
