"""Declared schemas by dataset name."""

from __future__ import annotations

from collections.abc import Callable

from ..operators.graph import FkDef, Schema


def testdata() -> Schema:
    """The star schema with two shared dimensions that the test tables hold."""
    s = Schema("testdata")
    s.add_table("region", ["r_regionkey", "r_name"], "r_regionkey")
    s.add_table("nation", ["n_nationkey", "n_name", "n_regionkey"], "n_nationkey")
    s.add_table("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "c_custkey")
    s.add_table("supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "s_suppkey")
    s.add_table("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "p_partkey")
    s.add_table("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "o_orderkey")
    s.add_table(
        "lineitem",
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    )
    s.add_relationship("region", "r_regionkey", "nation", "n_regionkey")
    s.add_relationship("nation", "n_nationkey", "customer", "c_nationkey")
    s.add_relationship("nation", "n_nationkey", "supplier", "s_nationkey")
    s.add_relationship("customer", "c_custkey", "orders", "o_custkey")
    s.add_relationship("orders", "o_orderkey", "lineitem", "l_orderkey")
    s.add_relationship("part", "p_partkey", "lineitem", "l_partkey")
    s.add_relationship("supplier", "s_suppkey", "lineitem", "l_suppkey")
    return s


#: The key that closes the one cycle of the test tables.
CYCLE = FkDef("nation", "n_nationkey", "supplier", "s_nationkey")


def _movies(name: str, tables: dict[str, list[str]], keys: list[tuple[str, str, str, str]], texts: dict[str, list[str]]) -> Schema:
    s = Schema(name, lower=True)
    for t, columns in tables.items():
        s.add_table(t, columns, "id" if "id" in columns else None, dict.fromkeys(texts.get(t, []), "string"))
    for key in keys:
        s.add_relationship(*key)
    return s


def imdb() -> Schema:
    # Tables, columns, text columns and keys of the public data set.
    tables = {
        "kind_type": ["id", "kind"],
        "title": ["id", "title", "imdb_index", "kind_id", "production_year", "phonetic_code", "season_nr", "episode_nr", "series_years"],
        "movie_companies": ["movie_id", "company_id", "company_type_id", "note"],
        "company_name": ["id", "name", "country_code"],
        "company_type": ["id", "kind"],
        "aka_title": ["movie_id"],
        "cast_info": ["person_id", "movie_id", "person_role_id", "note", "nr_order", "role_id"],
        "movie_info": ["movie_id", "info_type_id", "info", "note"],
        "movie_info_idx": ["movie_id", "info_type_id", "info"],
        "info_type": ["id", "info"],
        "complete_cast": ["movie_id", "subject_id", "status_id"],
        "comp_cast_type": ["id", "kind"],
        "movie_keyword": ["movie_id", "keyword_id"],
        "keyword": ["id", "keyword", "phonetic_code"],
        "movie_link": ["movie_id", "linked_movie_id", "link_type_id"],
        "link_type": ["id", "link"],
    }
    texts = {
        "kind_type": ["kind"], "title": ["title", "imdb_index", "phonetic_code", "series_years"], "movie_companies": ["note"],
        "company_name": ["name", "country_code"], "company_type": ["kind"], "cast_info": ["note"], "movie_info": ["info", "note"],
        "movie_info_idx": ["info"], "info_type": ["info"], "comp_cast_type": ["kind"], "keyword": ["keyword", "phonetic_code"], "link_type": ["link"],
    }
    keys = [
        ("kind_type", "id", "title", "kind_id"), ("title", "id", "movie_companies", "movie_id"), ("company_name", "id", "movie_companies", "company_id"),
        ("company_type", "id", "movie_companies", "company_type_id"), ("title", "id", "aka_title", "movie_id"), ("title", "id", "cast_info", "movie_id"),
        ("title", "id", "movie_info", "movie_id"), ("title", "id", "movie_info_idx", "movie_id"), ("info_type", "id", "movie_info_idx", "info_type_id"),
        ("title", "id", "complete_cast", "movie_id"), ("comp_cast_type", "id", "complete_cast", "subject_id"), ("title", "id", "movie_keyword", "movie_id"),
        ("keyword", "id", "movie_keyword", "keyword_id"), ("title", "id", "movie_link", "movie_id"), ("link_type", "id", "movie_link", "link_type_id"),
    ]
    return _movies("imdb", tables, keys, texts)


def imdb_job_light() -> Schema:
    # The six tables of the light benchmark.
    tables = {
        "title": ["id", "kind_id", "production_year"],
        "movie_companies": ["movie_id", "company_id", "company_type_id"],
        "cast_info": ["movie_id", "role_id"],
        "movie_info": ["movie_id", "info_type_id"],
        "movie_info_idx": ["movie_id", "info_type_id"],
        "movie_keyword": ["movie_id", "keyword_id"],
    }
    return _movies("imdb-job-light", tables, [("title", "id", t, "movie_id") for t in tables if t != "title"], {})


def _single(name: str, columns: list[str], casts: dict[str, str] | None = None) -> Callable[[], Schema]:
    def make() -> Schema:
        return Schema(name).add_table(name, columns, casts=casts)

    return make


# Columns of the vehicle registrations, in the order of the file.
DMV = [
    "Record Type", "Registration Class", "State", "County", "Body Type", "Fuel Type", "Reg Valid Date", "Color",
    "Scofflaw Indicator", "Suspension Indicator", "Revocation Indicator",
]
FLIGHTS = [
    "YEAR_DATE", "UNIQUE_CARRIER", "ORIGIN", "ORIGIN_STATE_ABR", "DEST", "DEST_STATE_ABR", "DEP_DELAY", "TAXI_OUT", "TAXI_IN", "ARR_DELAY", "AIR_TIME", "DISTANCE",
]
_DMV_CASTS = {"Reg Valid Date": "timestamp_ntz"}

SCHEMAS: dict[str, Callable[[], Schema]] = {
    "testdata": testdata,
    "imdb": imdb,
    "imdb-job-light": imdb_job_light,
    "dmv": _single("dmv", DMV, _DMV_CASTS),
    "dmv-tiny": _single("dmv-tiny", DMV, _DMV_CASTS),
    "dmv-1": _single("dmv-1", DMV[1:], _DMV_CASTS),
    "dmv-2": _single("dmv-2", DMV[1:3] + DMV[4:], _DMV_CASTS),
    "dmv-5": _single("dmv-5", DMV[5:], _DMV_CASTS),
    "flight-delays": _single("flight-delays", FLIGHTS, {"YEAR_DATE": "float"}),
    "flight-delays-tiny": _single("flight-delays-tiny", FLIGHTS, {"YEAR_DATE": "float"}),
}


def schema(name: str) -> Schema:
    if name not in SCHEMAS:
        raise ValueError(f"unknown dataset {name}; known: {', '.join(SCHEMAS)}")
    return SCHEMAS[name]()
