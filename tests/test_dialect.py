from datetime import datetime

import pytest

from tallyforge.functions.predicates import Predicate, normalize, split_by_tables, sql_of
from tallyforge.operators.graph import Schema, SchemaError, breadth_first, is_tree
from tallyforge.plans.sqlparse import ParseError, alias_tables, parse
from tallyforge.sources.schemas import CYCLE, SCHEMAS, imdb, imdb_job_light, schema
from tallyforge.sources.schemas import testdata as star


def test_conditions():
    q = parse(
        "SELECT COUNT(*) FROM a x, b AS y WHERE x.i = y.j AND x.n >= -3 AND y.t LIKE 'a''%' AND y.t NOT LIKE '_' AND x.k IN (1, 2.5, 'z') AND x.k NOT IN (4)"
        " AND x.d_date < '2001-02-03' AND y.f BETWEEN 1 AND 2 AND y.g IS NULL AND y.g IS NOT NULL AND y.h <> 5 AND y.h = NULL;"
    )
    assert q.tables == ("a", "b") and q.joins == ((("a", "i"), ("b", "j")),)
    assert [(p.name, p.op, p.value) for p in q.predicates] == [
        ("a.n", ">=", -3), ("b.t", "LIKE", "a'%"), ("b.t", "NOT LIKE", "_"), ("a.k", "IN", (1, 2.5, "z")), ("a.k", "NOT IN", (4,)),
        ("a.d_date", "<", datetime(2001, 2, 3)), ("b.f", "BETWEEN", (1, 2)), ("b.g", "IS", None), ("b.g", "IS NOT", None), ("b.h", "!=", 5), ("b.h", "=", None),
    ]


def test_joins_and_names():
    q = parse('SELECT COUNT(*) FROM "A" x JOIN b ON x.i = b.j AND b.k > 1 INNER JOIN c z ON (z.l = b.m) WHERE x.n < 4')
    assert q.tables == ("A", "b", "c") and len(q.joins) == 2 and len(q.predicates) == 2
    assert parse("SELECT COUNT(*) FROM T WHERE X > 1 AND DAY::timestamp IS NULL".replace("DAY::timestamp", "Y"), lower=True).predicates[0] == Predicate("t", "x", ">", 1)
    assert alias_tables("SELECT * FROM (SELECT * FROM a x, b) y LEFT JOIN c AS z ON z.i = y.i") == {"x": "a", "b": "b", "z": "c"}


@pytest.mark.parametrize("sql", [
    "SELECT 1", "SELECT COUNT(*) FROM a WHERE x = 1 OR y = 2", "SELECT COUNT(*) FROM a x, a y", "SELECT COUNT(*) FROM a, b WHERE i = 1",
    "SELECT COUNT(*) FROM a LEFT JOIN b ON a.i = b.i", "SELECT COUNT(*) FROM a, b WHERE a.i < b.i", "SELECT COUNT(*) FROM a WHERE i IN 3", "SELECT COUNT(*) FROM a WHERE q.i = 3",
])
def test_rejected(sql):
    with pytest.raises(ParseError):
        parse(sql)


def test_normal_forms():
    ps = normalize([Predicate("t", "a", "BETWEEN", (1, 2)), Predicate("t", "b", "="), Predicate("t", "b", "!="), Predicate("t", "a", ">=", 1)])
    assert [(p.op, p.value) for p in ps] == [(">=", 1), ("<=", 2), ("IS", None), ("IS NOT", None)]
    assert split_by_tables(ps, ["u"]) == ([], ps)
    assert sql_of(Predicate("t", "a", "IN", (1, "x'y")), "a") == "a IN (1, 'x''y')"
    with pytest.raises(ValueError):
        Predicate("t", "a", "~")


def test_schemas():
    assert len(imdb().tables) == 16 and len(imdb().fks) == 15 and len(imdb().neighbourhoods()) == 9
    assert len(imdb_job_light().neighbourhoods()) == 5 and len(imdb_job_light().universal().edges) == 5
    assert is_tree(imdb().universal().tables, imdb().universal().edges)
    with pytest.raises(SchemaError):
        star().universal()
    assert len(star().universal([CYCLE]).tables) == 7
    assert {len(SCHEMAS[d]().tables[d].columns) for d in ("dmv", "dmv-1", "dmv-2", "dmv-5")} == {11, 10, 9, 6}
    with pytest.raises(ValueError):
        schema("nothing")


def test_parallel_keys():
    s = Schema("p").add_table("person", ["id"], "id").add_table("edge", ["a", "b"])
    s.add_relationship("person", "id", "edge", "a").add_relationship("person", "id", "edge", "b")
    assert [x.name for x in s.neighbourhoods()] == ["edge:a=person.id", "edge:b=person.id"]
    assert s.fk_columns("edge") == ["a", "b"] and '"person" -> "edge"' in s.dot()
    assert [t for t, _, _ in breadth_first("person", s.fks[:1])] == ["person", "edge"]
