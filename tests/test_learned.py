"""Learned models through the command line: trained, stored, loaded in another session, evaluated; and their parts."""

import json
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import codes
from tallyforge.functions.predicates import Predicate, merged
from tallyforge.models import density
from tallyforge.operators import statistics
from tallyforge.plans import evaluation, learned

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_train_store_load_evaluate(tmp_path):
    """Each command is a process of its own, started outside the repository, on one CSV file."""
    r = random.Random(2)
    lines = ["Fuel Type,Reg Valid Date,Color,Scofflaw Indicator,Suspension Indicator,Revocation Indicator"]
    lines += [f"{r.choice(['GAS', 'DIESEL'])},2020-01-0{r.randrange(1, 9)},{r.choice(['RED', 'BLUE', 'GREY'])},N,{r.choice('NY')},N" for _ in range(600)]
    (tmp_path / "dmv.csv").write_text("\n".join(lines) + "\n")
    red = sum(",RED," in x for x in lines)
    sql = 'SELECT COUNT(*) FROM ""dmv-5"" d WHERE d.Color = \'RED\''
    (tmp_path / "b.csv").write_text(f'true_cardinality,sql,name,node\n{red},"{sql}",q1,dmv-5\n600,"{sql.split(" WHERE")[0]}",q2,dmv-5\n')
    common = ["--local", "--data-dir", str(tmp_path / "dmv.csv"), "-d", "dmv-5", "-s", "ur", "-m", str(tmp_path / "m"), "--eval-sample-size", "300"]

    def run(*more):
        done = subprocess.run([sys.executable, "-m", "tallyforge", *common, *more], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=600)
        assert done.returncode == 0, done.stderr[-3000:]

    run("--train", "--join-sample-size-min", "2000", "--join-sample-size-max", "2000", "-e", "2", "--dump-intermediates", "--params-dir", str(tmp_path / "p"))
    assert (tmp_path / "m" / "index").is_dir() and (tmp_path / "p" / "joined_tables").is_dir()
    run("--eval", "-b", str(tmp_path / "b.csv"), "-A", "--eval-order", "nat", "--out", str(tmp_path / "o"))
    out = tmp_path / "o"
    text = "".join(p.read_text() for p in (out / "results").glob("part-*"))
    assert text.count("\n") == 1 + 2 * 2 and "epoch" in text
    assert json.loads("".join(p.read_text() for p in (out / "params").glob("part-*")))["eval_order"] == "nat"
    assert "p_err" in "".join(p.read_text() for p in (out / "plan_costs").glob("part-*"))


def test_merged_sets():
    def p(op, v):
        return Predicate("t", "c", op, v)

    assert merged([p("IN", (1, 2, 3)), p("IN", (2, 3)), p("NOT IN", (3,)), p("LIKE", "a%")]) == [p("IN", (2,)), p("LIKE", "a%")]
    assert merged([p("NOT IN", (1,)), p("NOT IN", (2, 1))]) == [p("NOT IN", (1, 2))]
    assert merged([p("IN", (1,)), p(">", 0)]) == [p("IN", (1,)), p(">", 0)]
    with pytest.raises(ValueError):
        merged([p("IN", (1,)), p(">", 0)], strict=True)


def test_matching_codes_have_no_cap(spark):
    """A pattern that matches more than a million values."""
    found = spark.range(2, 1_200_002).select(F.concat(F.lit("v"), "id").alias("value"), F.col("id").alias("code"))
    got = learned.matching_codes(found, [Predicate("t", "c", "LIKE", "v%"), Predicate("t", "c", "!=", "v7")])
    assert len(got) == 1_199_999 and got[0] == 2 and got[-1] == 1_200_001 and 7 not in got


def test_slice_masks_leave_out_codes_beyond_the_domain():
    size, slices = 1000, codes.factorize(1000, 4)
    enc = learned.Encoded(["c"], {}, {"c": slices}, {"c": size}, {}, {}, {("c", s.index): s.index for s in slices}, [s.size for s in slices])
    steps = learned.bit_masks(enc, "c", np.arange(codes.NULL, size))
    every = np.arange(1 << sum(s.width for s in slices))
    x = np.stack([((every >> s.offset) & ((1 << s.width) - 1)) + 1 for s in slices], 1)
    ok = np.ones(len(every), bool)
    for column, mask in steps:
        ok &= mask(x)[np.arange(len(x)), x[:, column]] > 0
    assert np.flatnonzero(ok).tolist() == list(range(codes.NULL, size))


def test_continuous_columns_are_learned():
    """The mean of a number given a code, and the gradients of a mixed model."""
    rng = np.random.default_rng(1)
    kind = rng.integers(2, 4, 6000)
    rows = np.stack([kind, np.where(kind == 2, 1.0, 3.0)], 1)
    config = density.Config([4, 1], epochs=12, batch=256, lr=5e-3, continuous=[1])
    model, history = density.train(rows, config)
    seen = np.array([[2.0, 0], [3.0, 0]])
    assert np.abs(model.number(seen, 1) - [1, 3]).max() < 0.4 and history[-1] < history[0]
    small = density.Model.new(density.Config([4, 1], d_word=4, d_ff=5, n_ff=1, continuous=[1]))
    small.params = {k: v.astype(np.float64) + 0.1 * rng.normal(size=v.shape) for k, v in small.params.items()}
    x, hidden = rows[:20], rng.random((20, 2)) < 0.5
    hidden[:, 0] |= ~hidden.any(1)
    _, grads = small.loss(x, hidden)
    for key in ("num1", "dec1", "bias1", "emb0", "l0.w"):
        at = tuple(d // 2 for d in small.params[key].shape)
        was = small.params[key][at]
        small.params[key][at] = was + 1e-5
        up = small.loss(x, hidden)[0]
        small.params[key][at] = was - 1e-5
        down = small.loss(x, hidden)[0]
        small.params[key][at] = was
        assert abs((up - down) / 2e-5 - grads[key][at]) < 1e-3, key


def test_natural_order():
    assert sorted(["e10", "e9", "e1", "9", "10"], key=evaluation.natural) == ["9", "10", "e1", "e9", "e10"]


def test_jdbc_and_filled(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert {(r.col, r.n) for r in statistics.filled(df).collect()} == {("a", 2), ("b", 1)}
