"""Results that are computed once: every stage of preparing a database, stored as Parquet by what it was made from.

A folder holds fk_counts, fanouts, base_tables_with_fanouts, distinct_vals, joined_tables and discretized; each stage's name
ends with a hash of the schema, the source's name and the settings it depends on, so another configuration never reads it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Schema, SubSchema
from ..operators.sampling import sample_join
from ..operators.statistics import Tables, dictionary, fk_value_counts, name, with_adjacent_fanouts
from .loaders import stored


class Stages:
    """Stages of one schema's tables under ``folder`` (any path Spark writes to). source: names the data, e.g. its folder."""

    def __init__(self, schema: Schema, tables: Tables, folder: str, source: str = "") -> None:
        self.schema, self.tables, self.folder, self.source = schema, tables, folder.rstrip("/"), source
        self.spark = next(iter(tables.values())).sparkSession

    def path(self, kind: str, what: str, **settings: object) -> str:
        shape = {t.name: [list(t.columns), [list(c) for c in t.casts]] for t in self.schema.tables.values()}
        said = json.dumps([self.source, shape, sorted(e.condition for e in self.schema.fks), sorted(settings.items())], default=str)
        return f"{self.folder}/{kind}/{quote(what, safe='')}-{hashlib.sha256(said.encode()).hexdigest()[:16]}"

    def keep(self, kind: str, what: str, make: Callable[[], DataFrame], **settings: object) -> DataFrame:
        """Columns are stored as c0, c1, ... in the order of their names, which a comment of the schema keeps."""
        def plain() -> DataFrame:
            df = make()
            return df.select(*[name(c).alias(f"c{k}", metadata={"name": c}) for k, c in enumerate(sorted(df.columns))])

        df = stored(self.spark, self.path(kind, what, **settings), plain)
        return df.select(*[F.col(f.name).alias(f.metadata["name"]) for f in df.schema])

    def fk_counts(self, child: str, fk: str) -> DataFrame:
        return self.keep("fk_counts", f"{child}.{fk}", lambda: fk_value_counts(self.tables[child], fk))

    def base_with_fanouts(self, table: str) -> DataFrame:
        """The table's rows with its adjacent fanouts, columns by name."""
        edges = [e for e in self.schema.fks if table in (e.parent, e.child)]
        return self.keep("base_tables_with_fanouts", table, lambda: with_adjacent_fanouts(table, self.tables, edges))

    def fanouts(self, table: str) -> DataFrame:
        """The table's key, where it has one, and its adjacent fanouts."""
        key = self.schema.tables[table].key
        found = self.base_with_fanouts(table)
        return self.keep("fanouts", table, lambda: found.select(*[name(c) for c in found.columns if c == key or "_fanout__" in c]))

    def dictionary(self, table: str, column: str) -> DataFrame:
        return self.keep("distinct_vals", f"{table}.{column}", lambda: dictionary(self.tables[table], column))

    def dictionaries(self) -> dict[str, DataFrame]:
        """Dictionaries of all columns of all tables, read where they are stored."""
        return {f"{t.name}.{c}": self.dictionary(t.name, c) for t in self.schema.tables.values() for c in t.columns}

    def sample(self, sub: SubSchema, n: int, seed: int, make: Callable[[], DataFrame] | None = None, form: str = "plain") -> DataFrame:
        """A join sample of a partition; form: names what ``make`` makes in place of the plain sample."""
        tables = {t: self.tables[t] for t in sub.tables}
        return self.keep("joined_tables", sub.name, make or (lambda: sample_join(tables, sub.edges, sub.root, n, seed)), n=n, seed=seed, form=form)

    def discretized(self, sub: SubSchema, make: Callable[[], DataFrame], **settings: object) -> DataFrame:
        return self.keep(f"discretized/{settings.get('threshold', 'plain')}", sub.name, make, **settings)
