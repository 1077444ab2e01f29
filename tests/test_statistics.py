import numpy as np
import pytest

from pyspark.sql import functions as F
from tallyforge.functions import codes, measures
from tallyforge.functions.predicates import Predicate, condition
from tallyforge.models.density import Config, Model, masks, progressive, search, train
from tallyforge.operators import sampling, statistics
from tallyforge.operators.graph import FkDef, Schema, SchemaError
from tallyforge.plans import estimators, evaluation
from tallyforge.plans.database import Database
from tallyforge.plans.learned import LearnedNeighbourhoods, LearnedUniversal

AB, BC = FkDef("a", "id", "b", "a_id"), FkDef("b", "id", "c", "b_id")


@pytest.fixture(scope="module")
def chain(spark):
    """Keys that are null, dangle, or have no rows below them."""
    return {
        "a": spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, v string"),
        "b": spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 99), (14, None)], "id long, a_id long"),
        "c": spark.createDataFrame([(10, 1), (10, 2), (12, 3), (13, 4), (77, 5), (None, 6)], "b_id long, w int"),
    }


@pytest.fixture(scope="module")
def db(spark, chain):
    s = Schema("chain").add_table("a", ["id", "v"], "id").add_table("b", ["id", "a_id"], "id").add_table("c", ["b_id", "w"])
    s.add_relationship("a", "id", "b", "a_id").add_relationship("b", "id", "c", "b_id")
    return Database(spark, s, chain)


def test_sizes(spark, chain):
    joined = statistics.full_outer_join(chain, [AB, BC], "a")
    assert statistics.full_outer_size(chain, [AB, BC], "a").first().size == joined.count()
    assert statistics.reachable_size(chain, [AB, BC], "a").first().size == joined.where("`__in__:a`").count()
    inner = joined.where("`__in__:a` and `__in__:b` and `__in__:c`").count()
    assert statistics.count_by_messages(chain, [AB, BC], "b").first().cnt == inner == 3


def test_null_values_are_not_padding(chain):
    joined = statistics.full_outer_join(chain, [AB], "a")
    assert joined.where("`a.v` is null and `__in__:a`").count() == 1
    assert joined.where("not `__in__:a`").count() == 2


@pytest.mark.parametrize("sql, cnt", [
    ("SELECT COUNT(*) FROM a WHERE a.v IS NOT NULL", 2), ("SELECT COUNT(*) FROM a, b WHERE a.id = b.a_id", 3),
    ("SELECT COUNT(*) FROM b, c WHERE b.id = c.b_id AND c.w > 1", 3), ("SELECT COUNT(*) FROM a, b, c WHERE a.id = b.a_id AND b.id = c.b_id AND a.v = 'x'", 2),
    ("SELECT COUNT(*) FROM a, b WHERE a.id = b.a_id AND a.v = 'none'", 0),
])
def test_exact_forms_count(db, sql, cnt):
    assert db.count(sql).first().cnt == cnt == db.count_messages(sql).first().cnt
    assert estimators.universal_exact(db, db.schema.universal(), sql).first().cnt == cnt
    assert estimators.neighbourhood_exact(db, sql).first().cnt == cnt


def test_binding(db):
    with pytest.raises(SchemaError):
        db.bind("SELECT COUNT(*) FROM a, c WHERE a.id = c.w")
    with pytest.raises(SchemaError):
        db.bind("SELECT COUNT(*) FROM a, b")
    s = Schema("star").add_table("t", ["id"], "id").add_table("u", ["t_id"]).add_table("w", ["t_id"])
    s.add_relationship("t", "id", "u", "t_id").add_relationship("t", "id", "w", "t_id")
    b = Database(db.spark, s, {}).bind("SELECT COUNT(*) FROM u, w WHERE u.t_id = w.t_id")
    assert b.added == ("t",) and len(b.edges) == 2


def test_fanouts(chain):
    rows = statistics.with_adjacent_fanouts("b", chain, [AB, BC]).collect()
    assert {r.id: (r["b.__adj_fanout__:id=c.b_id"], r["b.__adj_fanout__:a_id=a.id"]) for r in rows} == {10: (2, 1), 11: (1, 1), 12: (1, 1), 13: (1, 1), 14: (1, 1)}


def test_sample(db, chain):
    rows = sampling.sample_join(chain, [AB, BC], "a", 4000, 7)
    assert rows.count() == 4000 and rows.select("sample").distinct().count() == 4000
    shares = {r[0]: r[1] / 4000 for r in rows.groupBy("`a.id`").count().collect()}
    assert all(abs(shares[k] - w / 5) < 0.04 for k, w in {1: 3, 2: 1, 3: 1}.items())
    below = {r[0]: r[1] for r in rows.where("`a.id` = 1").groupBy("`b.id`").count().collect()}
    assert abs(below[10] / below[11] - 2) < 0.35
    assert rows.where("`a.id` = 3 and (`__in__:b` or `b.id` is not null)").count() == 0
    assert sorted(r[0] for r in rows.collect()) == sorted(r[0] for r in sampling.sample_join(chain, [AB, BC], "a", 4000, 7).repartition(3).collect())
    truth = db.count("SELECT COUNT(*) FROM a, b WHERE a.id = b.a_id").first().cnt
    sql = "SELECT COUNT(*) FROM a, b WHERE a.id = b.a_id"
    assert abs(estimators.universal_sampled(db, db.schema.universal(), sql, n=3000).first().estimate - truth) <= 1
    assert sampling.sample_rows(chain["a"].limit(0).withColumn("w", F.lit(1)), "w", 5, 1, "t").count() == 0
    assert sampling.sample_size(5, 10, 20) == 10 and sampling.sample_size(15, 10, 20) == 15 and sampling.sample_size(99, 10, 20) == 20


def test_dictionary(spark, chain):
    d = statistics.dictionary(chain["a"], "v")
    assert {r.value: r.code for r in d.collect()} == {"x": 2, "y": 3}
    assert [r.code for r in statistics.encode(chain["a"], "v", d).orderBy("id").collect()] == [2, 3, 1]
    assert statistics.encode(chain["a"], "v", d, drop_null=True).count() == 2
    assert statistics.dictionary(chain["a"].limit(0), "v").count() == 0
    big = spark.range(1000).select((F.col("id") * 7).alias("v"))
    assert sorted(r.code for r in statistics.dictionary(big, "v").collect()) == list(range(2, 1002))


@pytest.mark.parametrize("domain", [3, 254, 255, 256, 257, 258, 65535, 65536, 65537, 65538, 1 << 20])
@pytest.mark.parametrize("threshold", [8, 16])
def test_factorize(domain, threshold):
    slices = codes.factorize(domain, threshold)
    assert sum(s.width for s in slices) >= (domain - 1).bit_length() and (len(slices) == 1) == (domain <= 1 << threshold)
    assert all(s.width <= threshold for s in slices) or len(slices) == 1
    for code in (0, 1, domain - 1, domain // 2):
        parts = [((code >> s.offset) & ((1 << s.width) - 1)) + 1 for s in slices]
        assert sum((p - 1) << s.offset for p, s in zip(parts, slices)) == code


def test_like(spark):
    texts = ["a_b", "a%b", "axb", "a\\b", "A_B", "a\nb", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    hit = lambda p, op="LIKE": {r.v for r in df.where(condition(Predicate("t", "v", op, p), F.col("v"))).collect()}
    assert hit("a_b") == {"a_b", "a%b", "axb", "a\\b", "a\nb"} and hit("a\\b") == {"a\\b"} and hit("%") == set(texts) - {None}
    assert hit("a_b", "NOT LIKE") == {"A_B", ""}


def test_measures(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 5, 5.0), (7, 0, 7.0), (2, 8, 4.0), (8, 2, 4.0)], "e long, t long, q double")
    assert df.where(measures.q_error(F.col("e"), F.col("t")) != F.col("q")).count() == 0
    for n in (1, 2, 4, 5, 6, 11):
        data = list(range(1, n + 1))
        got = {r.quantile: r.value for r in measures.nearest_quantiles(spark.createDataFrame([(float(x),) for x in data], "v double"), "v").collect()}
        assert got == {q: float(data[round(q * (n - 1))]) for q in measures.QUANTILES}


def test_networks_learn_and_sample():
    rng = np.random.default_rng(0)
    a = rng.integers(2, 8, 6000)
    x = np.stack([a, a * 1, rng.integers(2, 4, 6000)], 1)
    for kind in ("mlp", "trm"):
        model, history = train(x, Config([8, 8, 4], kind=kind, epochs=25, batch=256, d_word=16, lr=5e-3))
        assert history[-1] < history[0]
        mask = np.zeros(8)
        mask[[2, 3]] = 1
        p = progressive(model, [(0, mask), (1, mask)], 500, rng)
        assert abs(p.mean() - 1 / 3) < 0.08
        assert np.allclose(model.predict(x[:5], 1).sum(1), 1) and (model.predict(x[:5], 1)[:, 0] == 0).all()
    assert Model.new(Config([3])).params and masks(rng, 4, 1).all()
    best, config, loss = search(x[:500], [Config([8, 8, 4], epochs=2, d_word=8), Config([8, 8, 4], epochs=2, d_word=4)])
    assert np.isfinite(loss) and config.d_word in (4, 8) and best.params
    with pytest.raises(ValueError):
        Config([3], lr=None)


def test_learned(spark):
    s = Schema("pair").add_table("p", ["id", "k"], "id").add_table("q", ["p_id", "w"])
    s.add_relationship("p", "id", "q", "p_id")
    p = spark.range(200).select("id", (F.col("id") % 4).alias("k"))
    q = spark.range(1000).select((F.col("id") % 150).alias("p_id"), (F.col("id") % 300).alias("w"))
    db = Database(spark, s, {"p": p, "q": q})
    model = LearnedUniversal.fit(db, s.universal(), n=4000, config=Config([1], epochs=12, lr=5e-3), threshold=6)
    for sql in ("SELECT COUNT(*) FROM p, q WHERE p.id = q.p_id AND p.k = 1", "SELECT COUNT(*) FROM p WHERE p.k < 2", "SELECT COUNT(*) FROM q WHERE q.w < 150 AND q.w >= 20"):
        truth, guess = db.count(sql).first().cnt, model.estimate(sql).first().estimate
        assert max(truth / max(guess, 1), guess / truth) < 1.6, (sql, truth, guess)


def test_learned_chain(spark):
    s = Schema("chain").add_table("p", ["id", "k"], "id").add_table("q", ["id", "p_id", "w"], "id").add_table("r", ["q_id", "x"])
    s.add_relationship("p", "id", "q", "p_id").add_relationship("q", "id", "r", "q_id")
    p = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    q = spark.range(600).select("id", (F.col("id") % 90).alias("p_id"), (F.col("id") % 5).alias("w"))
    r = spark.range(1500).select((F.col("id") % 400).alias("q_id"), (F.col("id") % 7).alias("x"))
    db = Database(spark, s, {"p": p, "q": q, "r": r})
    model = LearnedNeighbourhoods.fit(db, n=4000, config=Config([1], epochs=12, lr=5e-3))
    for sql in (
        "SELECT COUNT(*) FROM p, q, r WHERE p.id = q.p_id AND q.id = r.q_id AND p.k = 1 AND r.x < 3", "SELECT COUNT(*) FROM p, q WHERE p.id = q.p_id AND q.w = 2",
        "SELECT COUNT(*) FROM r WHERE r.x = 1", "SELECT COUNT(*) FROM p WHERE p.k = 0",
    ):
        truth, guess = db.count(sql).first().cnt, model.estimate(sql).first().estimate
        assert max(truth / max(guess, 1), guess / truth) < 1.7, (sql, truth, guess)


def test_evaluation(db):
    sql = "SELECT COUNT(*) FROM a, b, c WHERE a.id = b.a_id AND b.id = c.b_id"
    r = evaluation.evaluate(db, "exact", db.count, [(3, sql)])
    assert r.first().q_err == 1.0 and {x.value for x in evaluation.summary(r).collect()} == {1.0}
    truth = {frozenset(x.tables.split(",")): float(x.cnt) for x in evaluation.true_cardinalities(db, sql).collect()}
    error, *_ = evaluation.plan_cost_error(db, sql, truth, truth)
    assert error == 1.0
    wrong = dict(truth)
    wrong[frozenset("ab")], wrong[frozenset("bc")] = 1000.0, 0.0
    assert evaluation.plan_cost_error(db, sql, wrong, truth)[0] >= 1.0
    assert evaluation.order_text((("a", "b"), "c")) == "((a b) c)"


def test_stream(spark, chain, tmp_path):
    from tallyforge.streaming.counts import keep_fk_counts

    chain["b"].write.parquet(str(tmp_path / "b"))
    stream = spark.readStream.schema(chain["b"].schema).parquet(str(tmp_path / "b"))
    keep_fk_counts(stream, "a_id", "b_counts", str(tmp_path / "ck")).awaitTermination(60)
    assert {r.a_id: r.n for r in spark.table("b_counts").collect()} == {1: 2, 2: 1, 99: 1}


def test_loaders(spark, tmp_path):
    from tallyforge.operators.graph import TableDef
    from tallyforge.sources import loaders

    (tmp_path / "t.csv").write_text('id,name,unused\n1,"a\\"b",x\n2,,y\n')
    df = loaders.read_table(spark, str(tmp_path / "t.csv"), TableDef("t", ("id", "name"), casts=(("id", "long"),)))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'a"b'), (2, None)]
    with pytest.raises(ValueError):
        loaders.clean(df, TableDef("t", ("gone",)))
    made = []
    for _ in range(2):
        loaders.stored(spark, str(tmp_path / "stage"), lambda: made.append(1) or df)
    assert made == [1]
    (tmp_path / "b.csv").write_text('true_cardinality,sql\n7,"SELECT COUNT(*) FROM a WHERE a.x IN (1,2);"\n')
    assert loaders.read_benchmark(spark, str(tmp_path / "b.csv")).first().true_cardinality == 7
    loaders.write_results(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
