"""Two-valued filters over null, scalar and array values, the dict form, and what is pushed down."""


import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memspark.functions import predicates as p

ROWS = [(1, "a", 1.0, ["x", "y"]), (2, None, None, None), (3, "b", 2.5, []), (4, "", 0.0, ["z", None]), (5, "a", -1.0, ["a"])]
VALUES = [{"s": r[1], "n": r[2], "t": r[3]} for r in ROWS]


def holds(e, row):
    """The reference semantics on plain values."""
    if isinstance(e, p.Group):
        parts = [holds(c, row) for c in e.children]
        return all(parts) if e.op == "and" else any(parts) if e.op == "or" else not parts[0]
    v = row[e.field]
    if e.op in ("ne", "not_in"):
        return not holds(p.Leaf(e.field, p.OPPOSITE[e.op], e.value), row)
    if v is None:
        return False
    if e.op == "contains":
        return isinstance(v, list) and e.value in v
    if isinstance(v, list):
        return False
    if e.op in p.COMPARE:
        return isinstance(v, float) and {"gt": v > e.value, "gte": v >= e.value, "lt": v < e.value, "lte": v <= e.value}[e.op]
    values = e.value if e.op == "in" else (e.value,)
    return any(type(x) is type(v) and x == v for x in values)


LEAVES = [p.Leaf(f, op, v) for f in ("s", "n", "t") for op, v in (("eq", "a"), ("eq", 1.0), ("ne", "a"), ("ne", 2.5), ("in", ("a", "b")), ("in", (1.0, 0.0)), ("not_in", ("a", "")), ("gt", 0.5), ("gte", 1.0), ("lt", 1.0), ("lte", 0.0), ("contains", "x"), ("contains", "a"))]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "i int, s string, n double, t array<string>").cache()


def test_every_leaf_and_its_negation(frame):
    resolve = p.resolver(frame.dtypes)
    exprs = [x for leaf in LEAVES for x in (leaf, p.Group("not", (leaf,)))]
    got = frame.select("i", *(p.truth(x, resolve).alias(f"c{k}") for k, x in enumerate(exprs))).orderBy("i").collect()
    for r, v in zip(got, VALUES, strict=True):
        assert [r[f"c{k}"] for k in range(len(exprs))] == [holds(x, v) for x in exprs]


tree = st.recursive(st.sampled_from(LEAVES), lambda c: st.one_of(st.builds(lambda op, a: p.Group(op, tuple(a)), st.sampled_from(["and", "or"]), st.lists(c, min_size=1, max_size=3)), st.builds(lambda a: p.Group("not", (a,)), c)), max_leaves=8)


@settings(max_examples=15, deadline=None)
@given(st.lists(tree, min_size=20, max_size=20))
def test_trees(frame, exprs):
    resolve = p.resolver(frame.dtypes)
    got = frame.select("i", *(p.truth(x, resolve).alias(f"c{k}") for k, x in enumerate(exprs))).orderBy("i").collect()
    for r, v in zip(got, VALUES, strict=True):
        assert [r[f"c{k}"] for k in range(len(exprs))] == [holds(x, v) for x in exprs]


@settings(max_examples=100, deadline=None)
@given(tree)
def test_dict_form_keeps_the_meaning(e):
    again = p.parse(p.unparse(e))
    assert all(holds(again, v) == holds(e, v) for v in VALUES)


@pytest.mark.parametrize("bad", [{}, [], {"AND": []}, {"a": {}}, {"a": {"in": []}}, {"a": {"in": [1, "x"]}}, {"a": {"gt": "x"}}, {"a": {"gt": float("nan")}}, {"a": {"like": "x"}}, {"a": None}])
def test_malformed(bad):
    with pytest.raises(p.FilterError):
        p.parse(bad)


def test_names():
    assert [p.canonical(n) for n in ("tier", "k", "system_metadata.k")] == ["tier", "user_metadata.k", "system_metadata.k"]
    for n in ("user", "scope.org"):
        with pytest.raises(p.FilterError):
            p.canonical(n)


def test_required_equality():
    a, b = p.Leaf("s", "eq", "a"), p.Leaf("n", "gt", 1.0)
    assert p.required_equality(p.Group("and", (b, a)), "s") == "a"
    assert p.required_equality(p.Group("or", (a, b)), "s") is None
    assert p.required_equality(p.Group("or", (a, p.Group("and", (a, b)))), "s") == "a"
    assert p.required_equality(p.Group("not", (a,)), "s") is None


def test_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(ROWS, "i int, s string, n double, t array<string>").write.parquet(path)
    df = spark.read.parquet(path)
    expr = p.parse({"NOT": {"OR": [{"n": {"gt": 1.0}}, {"s": "a"}]}})
    plan = df.where(p.predicate(expr, p.resolver(df.dtypes))).select("i")._jdf.queryExecution().executedPlan().toString()
    assert "Or(IsNull(n),LessThanOrEqual(n,1.0))" in plan and "Or(IsNull(s),Not(EqualTo(s,a)))" in plan
    assert "ReadSchema: struct<i:int,s:string,n:double>" in plan


def test_merged_or_cannot_widen():
    user = p.parse({"OR": [{"s": "a"}, {"n": {"gt": 0}}]})
    merged = p.and_merge(user, p.Leaf("s", "eq", "b"))
    for v in VALUES:
        assert holds(merged, v) == (holds(user, v) and v["s"] == "b")
    assert p.and_merge(None) is None
