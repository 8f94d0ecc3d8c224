"""What is known about tables: their eras, keys, foreign keys, views and history; kept as one JSON document.

The catalog checks what it is told (columns, types, names, dependencies) and validates data against it on demand.
"""

from __future__ import annotations

import enum
import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.period import boundary_type, is_discrete
from tidemark.operators import keys as rules
from tidemark.operators.merge import TemporalMerge, temporal_merge

NAME = re.compile(r"^[a-z_][0-9a-z_]*$")
NAME_BYTES = 63


class DropBehavior(enum.Enum):
    RESTRICT = "restrict"
    CASCADE = "cascade"


class KeyType(enum.Enum):
    PRIMARY = "primary"
    NATURAL = "natural"
    PREDICATED = "predicated"
    EXCLUSIVE = "exclusive"


class FkType(enum.Enum):
    TEMPORAL_TO_TEMPORAL = "temporal_to_temporal"
    REGULAR_TO_TEMPORAL = "regular_to_temporal"


class FkMatch(enum.Enum):
    SIMPLE = "simple"
    FULL = "full"


class FkAction(enum.Enum):
    NO_ACTION = "no action"
    RESTRICT = "restrict"


class CatalogError(ValueError):
    pass


@dataclass
class Era:
    table: str
    name: str = "valid"
    valid_from: str = "valid_from"
    valid_until: str = "valid_until"
    valid_to: str | None = None
    ephemeral: list[str] = field(default_factory=list)


@dataclass
class UniqueKey:
    name: str
    table: str
    era: str
    columns: list[str]
    kind: str = "natural"
    predicate: str | None = None
    exclusive_columns: list[str] = field(default_factory=list)


@dataclass
class ForeignKey:
    name: str
    table: str
    columns: list[str]
    parent: str
    parent_key: str
    kind: str
    era: str | None = None
    match: str = "simple"


@dataclass
class View:
    table: str
    era: str
    kind: str
    delete_mode: str | None = None


def make_name(*parts: str, suffix: str = "") -> str:
    """The parts joined by underscores and cut to the length of an identifier, the suffix being kept."""
    body, tail = "_".join(parts).encode(), f"_{suffix}".encode() if suffix else b""
    return (body[: NAME_BYTES - len(tail)].decode(errors="ignore")) + tail.decode()


def _outside_strings(text: str, change) -> str:
    """text with change applied to what stands outside its quoted strings."""
    return "".join(part if part.startswith("'") else change(part) for part in re.split(r"('(?:[^']|'')*')", text))


class Catalog:
    def __init__(self):
        self.eras: list[Era] = []
        self.unique_keys: list[UniqueKey] = []
        self.foreign_keys: list[ForeignKey] = []
        self.views: list[View] = []
        self.history: dict[str, list[str]] = {}
        self.suspended: set[str] = set()

    # -- eras -------------------------------------------------------------------------------------------------------

    def era(self, table: str, name: str | None = None) -> Era:
        found = [e for e in self.eras if e.table == table and name in (None, e.name)]
        if len(found) != 1:
            raise CatalogError(f"{table} has {'no such era' if not found else 'several eras; name one'}")
        return found[0]

    def add_era(self, table: str, df: DataFrame, name: str = "valid", **columns) -> Era:
        """Register an era after checking its columns, their types, and that every period starts before it ends."""
        era = Era(table, name, **columns)
        if not NAME.match(name):
            raise CatalogError(f"{name!r} is not a name for an era")
        if any(e.table == table and e.name == name for e in self.eras):
            raise CatalogError(f"{table} has an era {name} already")
        missing = [c for c in (era.valid_from, era.valid_until, era.valid_to, *era.ephemeral) if c and c not in df.columns]
        if missing:
            raise CatalogError(f"{table} has no columns {', '.join(missing)}")
        kind = boundary_type(df, era.valid_from)
        if boundary_type(df, era.valid_until) != kind or (era.valid_to and boundary_type(df, era.valid_to) != kind):
            raise CatalogError("the boundaries of an era are of one type")
        if era.valid_to and not is_discrete(kind):
            raise CatalogError("valid_to needs a discrete type")
        self._check_ephemeral(era, era.ephemeral)
        if not df.where(F.col(era.valid_from).isNull() | F.col(era.valid_until).isNull() | (F.col(era.valid_from) >= F.col(era.valid_until))).isEmpty():
            raise CatalogError(f"{table} has rows without a period")
        self.eras.append(era)
        return era

    def _check_ephemeral(self, era: Era, columns: list[str]) -> None:
        if {era.valid_from, era.valid_until, era.valid_to} & set(columns):
            raise CatalogError("temporal columns can't be ephemeral")

    def set_ephemeral(self, table: str, columns: list[str], df: DataFrame, era: str = "valid") -> None:
        found = self.era(table, era)
        self._check_ephemeral(found, columns)
        if set(columns) - set(df.columns):
            raise CatalogError("no such columns")
        found.ephemeral = list(columns)

    def drop_era(self, table: str, name: str = "valid", behavior: DropBehavior = DropBehavior.RESTRICT) -> None:
        era = self.era(table, name)
        keys = [k for k in self.unique_keys if (k.table, k.era) == (table, name)]
        own = [f for f in self.foreign_keys if f.table == table and f.era == name]
        views = [v for v in self.views if (v.table, v.era) == (table, name)]
        if behavior is DropBehavior.RESTRICT and (keys or own or views or table in self.history):
            raise CatalogError(f"other objects depend on era {name} of {table}")
        for f in own:
            self.foreign_keys.remove(f)
        for k in keys:
            self.drop_unique_key(k.name, DropBehavior.CASCADE)
        self.views = [v for v in self.views if v not in views]
        self.eras.remove(era)

    # -- keys -------------------------------------------------------------------------------------------------------

    def add_unique_key(self, table: str, columns: list[str], kind: KeyType = KeyType.NATURAL, era: str = "valid", predicate: str | None = None, exclusive_columns: list[str] | None = None, name: str | None = None) -> UniqueKey:
        self.era(table, era)
        if (predicate is not None) != (kind is KeyType.PREDICATED):
            raise CatalogError("a predicated key, and only it, has a predicate")
        if exclusive_columns and (kind is not KeyType.EXCLUSIVE or not set(exclusive_columns) <= set(columns)):
            raise CatalogError("mutually exclusive columns are part of an exclusive key")
        if kind is KeyType.PRIMARY and any(k.table == table and k.kind == "primary" for k in self.unique_keys):
            raise CatalogError(f"{table} has a primary key already")
        key = UniqueKey(name or make_name(table, *columns, suffix=era), table, era, list(columns), kind.value, predicate, list(exclusive_columns or []))
        if any(k.name == key.name for k in self.unique_keys):
            raise CatalogError(f"there is a key {key.name} already")
        self.unique_keys.append(key)
        return key

    def drop_unique_key(self, name: str, behavior: DropBehavior = DropBehavior.RESTRICT) -> None:
        key = self._named(self.unique_keys, name)
        users = [f for f in self.foreign_keys if f.parent_key == name]
        if users and behavior is DropBehavior.RESTRICT:
            raise CatalogError(f"foreign keys depend on {name}")
        for f in users:
            self.foreign_keys.remove(f)
        self.unique_keys.remove(key)

    def add_foreign_key(self, table: str, columns: list[str], parent: str, parent_columns: list[str], era: str | None = None, match: FkMatch = FkMatch.SIMPLE, on_delete: FkAction = FkAction.NO_ACTION, on_update: FkAction = FkAction.NO_ACTION, name: str | None = None) -> ForeignKey:
        """Temporal if the table has an era, regular otherwise; the parent's key is primary or natural, the primary first."""
        if not isinstance(on_delete, FkAction) or not isinstance(on_update, FkAction):
            raise CatalogError("CASCADE, SET NULL and SET DEFAULT are not supported")
        found = [k for k in self.unique_keys if k.table == parent and k.columns == list(parent_columns) and k.kind in ("primary", "natural")]
        if not found:
            raise CatalogError(f"{parent} has no primary or natural key of these columns")
        key = min(found, key=lambda k: k.kind != "primary")
        temporal = any(e.table == table for e in self.eras)
        own = self.era(table, era).name if temporal else None
        fk = ForeignKey(name or make_name(table, *columns, suffix=own or "fk"), table, list(columns), parent, key.name, (FkType.TEMPORAL_TO_TEMPORAL if temporal else FkType.REGULAR_TO_TEMPORAL).value, own, match.value)
        if any(f.name == fk.name for f in self.foreign_keys):
            raise CatalogError(f"there is a foreign key {fk.name} already")
        self.foreign_keys.append(fk)
        return fk

    def drop_foreign_key(self, name: str) -> None:
        self.foreign_keys.remove(self._named(self.foreign_keys, name))

    @staticmethod
    def _named(items: list, name: str):
        found = [x for x in items if x.name == name]
        if not found:
            raise CatalogError(f"there is no {name}")
        return found[0]

    # -- views and history ------------------------------------------------------------------------------------------

    def add_view(self, table: str, kind: str, era: str = "valid", delete_mode: str | None = None) -> View:
        self.era(table, era)
        if kind not in ("for_portion_of", "current"):
            raise CatalogError(f"unknown view type {kind}")
        view = View(table, era, kind, delete_mode or ("delete_as_cutoff" if kind == "current" else None))
        self.views.append(view)
        return view

    def drop_view(self, table: str, kind: str, era: str = "valid") -> None:
        self.views = [v for v in self.views if (v.table, v.kind, v.era) != (table, kind, era)]

    def add_system_versioning(self, table: str, excluded: list[str] | None = None) -> None:
        self.history[table] = list(excluded or [])

    def set_excluded_columns(self, table: str, excluded: list[str]) -> None:
        if table not in self.history:
            raise CatalogError(f"{table} has no history")
        self.history[table] = list(excluded)

    def drop_system_versioning(self, table: str) -> None:
        self.history.pop(table)

    # -- guards -----------------------------------------------------------------------------------------------------

    def check_drop_column(self, table: str, column: str) -> None:
        """Raise if something registered needs the column."""
        for e in (e for e in self.eras if e.table == table):
            if column in (e.valid_from, e.valid_until, e.valid_to, *e.ephemeral):
                raise CatalogError(f"era {e.name} needs {table}.{column}")
        for k in (k for k in self.unique_keys if k.table == table):
            if column in k.columns:
                raise CatalogError(f"key {k.name} needs {table}.{column}")
        for k in (k for k in self.unique_keys if k.table == table and k.predicate):
            named: list[str] = []
            _outside_strings(k.predicate, lambda part: named.extend(re.findall(r"\w+", part)) or part)
            if column in named:
                raise CatalogError(f"the predicate of {k.name} needs {table}.{column}")
        for f in (f for f in self.foreign_keys if f.table == table):
            if column in f.columns:
                raise CatalogError(f"foreign key {f.name} needs {table}.{column}")

    def drop_table(self, table: str) -> None:
        """Forget a table; refused while other tables refer to it."""
        if any(f.parent == table and f.table != table for f in self.foreign_keys):
            raise CatalogError(f"foreign keys refer to {table}")
        self.foreign_keys = [f for f in self.foreign_keys if f.table != table]
        self.unique_keys = [k for k in self.unique_keys if k.table != table]
        self.views = [v for v in self.views if v.table != table]
        self.eras = [e for e in self.eras if e.table != table]
        self.history.pop(table, None)

    def rename_column(self, table: str, old: str, new: str) -> None:
        """Follow the renaming of a column."""
        swap = lambda c: new if c == old else c
        for e in (e for e in self.eras if e.table == table):
            e.valid_from, e.valid_until, e.valid_to, e.ephemeral = swap(e.valid_from), swap(e.valid_until), swap(e.valid_to), [swap(c) for c in e.ephemeral]
        for k in (k for k in self.unique_keys if k.table == table):
            k.columns, k.exclusive_columns = [swap(c) for c in k.columns], [swap(c) for c in k.exclusive_columns]
            if k.predicate:
                k.predicate = _outside_strings(k.predicate, lambda part: re.sub(rf"\b{re.escape(old)}\b", new, part))
        for f in (f for f in self.foreign_keys if f.table == table):
            f.columns = [swap(c) for c in f.columns]
        if table in self.history:
            self.history[table] = [swap(c) for c in self.history[table]]

    def disable_checks(self, *tables: str) -> None:
        self.suspended |= set(tables)

    def enable_checks(self, *tables: str) -> None:
        self.suspended -= set(tables)

    # -- data -------------------------------------------------------------------------------------------------------

    def violations(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """For each key and foreign key of the given tables, the rows that break it, and under the name of a natural key with
        _one_owner its values that ever belonged to more than one primary key; suspended tables are left out."""
        out = {}
        for k in self.unique_keys:
            if k.table in tables and k.table not in self.suspended:
                e = self.era(k.table, k.era)
                out[k.name] = rules.unique_key_violations(tables[k.table], k.columns, k.kind, k.predicate, e.valid_from, e.valid_until)
                primary = next((x.columns for x in self.unique_keys if x.table == k.table and x.era == k.era and x.kind == "primary"), None)
                if primary and k.kind in ("natural", "exclusive") and set(primary) != set(k.columns):
                    out[f"{k.name}_one_owner"] = rules.pk_consistency_violations(tables[k.table], k.columns, primary, k.kind == "exclusive")
        for f in self.foreign_keys:
            if {f.table, f.parent} <= set(tables) and f.table not in self.suspended:
                key = self._named(self.unique_keys, f.parent_key)
                p = self.era(key.table, key.era)
                if f.era:
                    e = self.era(f.table, f.era)
                    out[f.name] = rules.temporal_fk_violations(tables[f.table], tables[f.parent], f.columns, key.columns, e.valid_from, e.valid_until, p.valid_from, p.valid_until, f.match)
                else:
                    out[f.name] = rules.regular_fk_violations(tables[f.table], tables[f.parent], f.columns, key.columns, f.match)
        return out

    def validate(self, tables: dict[str, DataFrame]) -> None:
        broken = [name for name, rows in self.violations(tables).items() if not rows.isEmpty()]
        if broken:
            raise CatalogError(f"violated: {', '.join(sorted(broken))}")

    def merge(self, table: str, target: DataFrame, source: DataFrame, era: str = "valid", **spec) -> TemporalMerge:
        """temporal_merge with what the catalog knows: the era's columns, the primary key as identity, the natural keys
        (fewest columns first) for lookups, each widened keyword taking precedence."""
        e = self.era(table, era)
        own = [k for k in self.unique_keys if k.table == table and k.era == era]
        natural = sorted((k for k in own if k.kind in ("natural", "exclusive")), key=lambda k: (len(k.columns), k.name))
        primary = [k.columns for k in own if k.kind == "primary"]
        given = {"f": e.valid_from, "u": e.valid_until, "to": e.valid_to, "ephemeral": tuple(e.ephemeral)}
        given["identity"] = tuple(primary[0] if primary else natural[0].columns if natural else ())
        given["natural_keys"] = tuple(tuple(k.columns) for k in natural if list(k.columns) != list(given["identity"]))
        return temporal_merge(target, source, **(given | spec))

    def eras_frame(self, spark: SparkSession) -> DataFrame:
        schema = "table string, name string, valid_from string, valid_until string, valid_to string, ephemeral array<string>"
        return spark.createDataFrame([tuple(asdict(e).values()) for e in self.eras], schema)

    def to_json(self) -> str:
        kinds = {"eras": self.eras, "unique_keys": self.unique_keys, "foreign_keys": self.foreign_keys, "views": self.views}
        return json.dumps({k: [asdict(x) for x in v] for k, v in kinds.items()} | {"history": self.history, "suspended": sorted(self.suspended)}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        raw, out = json.loads(text), cls()
        out.eras, out.unique_keys = [Era(**x) for x in raw["eras"]], [UniqueKey(**x) for x in raw["unique_keys"]]
        out.foreign_keys, out.views, out.history = [ForeignKey(**x) for x in raw["foreign_keys"]], [View(**x) for x in raw["views"]], raw["history"]
        out.suspended = set(raw.get("suspended", ()))
        return out
