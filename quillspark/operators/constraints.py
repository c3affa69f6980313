"""Table definitions and their constraints: each check is a plan that returns what violates it."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null in any of the columns."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.filter(bad)


def unique_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """The column values that more than one row has, with n, how many. Nulls count as equal."""
    rows = "_n" + "_".join(columns)  # no column's name
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(rows)).filter(F.col(f"`{rows}`") > 1).withColumnRenamed(rows, "n")


def foreign_key_violations(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Rows of `child` whose key no row of `parent` has; a key with a null part passes."""
    on, whole = None, F.lit(True)
    keys = parent.select(*(F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_columns)))
    for i, c in enumerate(columns):
        one = child[c] == keys[f"_p{i}"]
        on = one if on is None else on & one
        whole = whole & child[c].isNotNull()
    return child.filter(whole).join(keys, on, "left_anti")


def check_violations(df: DataFrame, check: Column) -> DataFrame:
    """Rows for which the check is false; null passes."""
    return df.filter(~check)


def on_delete(child: DataFrame, columns: list[str], gone: DataFrame, gone_columns: list[str], rule: str, defaults: dict | None = None) -> DataFrame:
    """`child` after the parent rows `gone` have been deleted: CASCADE deletes the rows that refer to them, SET NULL and SET DEFAULT change
    their key. With NO ACTION and RESTRICT the rows stay, and foreign_key_violations() tells them. A key with a null part refers to none."""
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    if rule in ("NO ACTION", "RESTRICT"):
        return child
    keys = gone.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(gone_columns))).distinct()
    on = F.lit(True)
    for i, c in enumerate(columns):
        on = on & (child[c] == keys[f"_g{i}"])
    if rule == "CASCADE":
        return child.join(keys, on, "left_anti")
    hit = F.col("_g0").isNotNull()
    new = {c: F.lit((defaults or {}).get(c) if rule == "SET DEFAULT" else None).cast(child.schema[c].dataType) for c in columns}
    return child.join(keys, on, "left").select(*(F.when(hit, new[c]).otherwise(child[c]).alias(c) if c in new else child[c] for c in child.columns))


#: What happens to rows that refer to a deleted one.
RULES = ("NO ACTION", "RESTRICT", "CASCADE", "SET NULL", "SET DEFAULT")


@dataclass(frozen=True)
class Table:
    """A table's definition. Columns are (name, Spark type); a foreign key is (columns, parent, its columns, rule on delete), NO ACTION
    where the rule is left out. Alterations return a new definition."""

    name: str
    columns: tuple[tuple[str, str], ...]
    not_null: tuple[str, ...] = ()
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[tuple[str, str], ...] = ()
    foreign_keys: tuple[tuple, ...] = ()
    defaults: dict = field(default_factory=dict)

    def __post_init__(self):
        have = {n for n, _ in self.columns}
        named = [*self.not_null, *self.primary_key, *(c for u in self.unique for c in u), *(c for k in self.foreign_keys for c in k[0]), *self.defaults]
        if missing := [c for c in named if c not in have]:
            raise ValueError(f"{self.name} has no column {missing[0]}")
        if bad := [k[3] for k in self.foreign_keys if len(k) > 3 and k[3] not in RULES]:
            raise ValueError(f"no such rule: {bad[0]}")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Table:
        held = lambda x: tuple(map(held, x)) if isinstance(x, list) else x
        return Table(**{k: held(v) for k, v in json.loads(text).items()})

    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in self.columns))

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema())

    def add_column(self, name: str, kind: str, default: object = None) -> Table:
        return replace(self, columns=(*self.columns, (name, kind)), defaults=self.defaults | ({} if default is None else {name: default}))

    def drop_column(self, name: str) -> Table:
        """Keys and checks that name the column go with it."""
        named = re.compile(rf"(?<![\w`]){re.escape(name)}(?!\w)", re.I).search
        return replace(
            self, columns=tuple(c for c in self.columns if c[0] != name), defaults={k: v for k, v in self.defaults.items() if k != name},
            not_null=tuple(c for c in self.not_null if c != name), primary_key=() if name in self.primary_key else self.primary_key,
            unique=tuple(u for u in self.unique if name not in u), foreign_keys=tuple(k for k in self.foreign_keys if name not in k[0]),
            checks=tuple(c for c in self.checks if not named(c[1].replace("`", " "))),
        )

    def set_type(self, name: str, kind: str) -> Table:
        return replace(self, columns=tuple((n, kind if n == name else t) for n, t in self.columns))

    def set_default(self, name: str, value: object) -> Table:
        """None drops the default."""
        rest = {k: v for k, v in self.defaults.items() if k != name}
        return replace(self, defaults=rest | ({} if value is None else {name: value}))

    def set_not_null(self, name: str, on: bool = True) -> Table:
        return replace(self, not_null=(*(c for c in self.not_null if c != name), *([name] if on else [])))

    def add_primary_key(self, *columns: str) -> Table:
        if self.primary_key:
            raise ValueError(f"{self.name} has a primary key")
        return replace(self, primary_key=columns)

    def drop_primary_key(self) -> Table:
        return replace(self, primary_key=())

    def add_unique(self, *columns: str) -> Table:
        return replace(self, unique=(*self.unique, columns))

    def drop_unique(self, *columns: str) -> Table:
        return replace(self, unique=tuple(u for u in self.unique if u != columns))

    def add_check(self, name: str, text: str) -> Table:
        return replace(self, checks=(*self.checks, (name, text)))

    def drop_check(self, name: str) -> Table:
        return replace(self, checks=tuple(c for c in self.checks if c[0] != name))

    def add_foreign_key(self, columns: tuple[str, ...], parent: str, parent_columns: tuple[str, ...], rule: str = "NO ACTION") -> Table:
        return replace(self, foreign_keys=(*self.foreign_keys, (columns, parent, parent_columns, rule)))

    def drop_foreign_key(self, *columns: str) -> Table:
        return replace(self, foreign_keys=tuple(k for k in self.foreign_keys if k[0] != columns))

    def fitted(self, df: DataFrame) -> DataFrame:
        """`df` with this definition's columns: new ones get their default, others go."""
        have = set(df.columns)
        return df.select(*((F.col(n) if n in have else F.lit(self.defaults.get(n))).cast(t).alias(n) for n, t in self.columns))

    def after_delete(self, df: DataFrame, parent: str, gone: DataFrame) -> DataFrame:
        """This table's rows `df` after the rows `gone` of a parent have been deleted, by the rules of the keys that refer to it."""
        for columns, name, parent_columns, *rule in self.foreign_keys:
            if name == parent:
                df = on_delete(df, list(columns), gone, list(parent_columns), rule[0] if rule else "NO ACTION", self.defaults)
        return df

    def violations(self, df: DataFrame, parents: dict[str, DataFrame] | None = None) -> DataFrame:
        """rule, n: how many rows (or keys, for uniqueness) violate each rule that is violated. All NOT NULL and CHECK rules are counted in
        one pass; a key takes a shuffle of its own."""
        spark = df.sparkSession
        none = spark.createDataFrame([], "rule string, n bigint")
        bad = [(f"NOT NULL {c}", F.col(c).isNull()) for c in sorted({*self.not_null, *self.primary_key})]
        bad += [(f"CHECK {name}", ~F.expr(text)) for name, text in self.checks]
        out = none
        if bad:
            counts = df.agg(*(F.count_if(rule).alias(f"_{i}") for i, (_, rule) in enumerate(bad)))
            pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"_{i}").alias("n")) for i, (name, _) in enumerate(bad)))
            out = out.union(counts.select(F.explode(pairs).alias("x")).select("x.rule", "x.n"))
        found = [(f"UNIQUE {', '.join(columns)}", unique_violations(df, list(columns))) for columns in [self.primary_key, *self.unique] if columns]
        for columns, parent, parent_columns, *_ in self.foreign_keys:
            found.append((f"FOREIGN KEY {', '.join(columns)}", foreign_key_violations(df, list(columns), (parents or {})[parent], list(parent_columns))))
        for rule, rows in found:
            out = out.union(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n"))
        return out.filter("n > 0")
