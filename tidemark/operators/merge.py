"""Set-based temporal merge: source rows with periods are merged into the history of their entities.

Only entities that the source names are looked at: the target is filtered by their keys first. The history of an entity is
cut at all boundaries of its source and target rows; one sweep finds the target row and the source rows that answer for each
piece, and column expressions that the mode fixes give its payload; equal neighbours are coalesced; the result is compared
with the target. Everything from the cutting on is partitioned by one grouping key. The target is not changed: the merge
gives a new snapshot, the operations that lead to it, and an outcome for every source row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tidemark.functions.period import allen, forever, is_discrete, predecessor, successor
from tidemark.operators import sweep
from tidemark.operators.graph import components
from tidemark.operators.ordering import dealt
from tidemark.sources.snapshots import settled

MODES = (
    "MERGE_ENTITY_PATCH", "MERGE_ENTITY_UPSERT", "MERGE_ENTITY_REPLACE", "INSERT_NEW_ENTITIES",
    "PATCH_FOR_PORTION_OF", "UPDATE_FOR_PORTION_OF", "REPLACE_FOR_PORTION_OF", "DELETE_FOR_PORTION_OF",
)
DELETE_MODES = ("NONE", "DELETE_MISSING_TIMELINE", "DELETE_MISSING_ENTITIES", "DELETE_MISSING_TIMELINE_AND_ENTITIES")
NO_PLAN = "Planner failed to generate a plan for this source row."


@dataclass(frozen=True)
class MergeSpec:
    """What a merge needs to know about the tables.

    identity: the columns that stand for an entity. natural_keys: lists of columns that find an entity, any of which is
    enough. row_id: a whole number for each source row; later ones win. founding_id: source rows of a new entity share it.
    ephemeral: columns that don't make two rows differ. required: target columns that are NOT NULL or have a default; a
    null never overwrites them. defaults: values for new rows. generated_identity: an integer identity column that new
    entities without one get. f, u, to: the boundary columns of both sides, `to` being the inclusive end if there is one.
    """

    identity: tuple[str, ...]
    natural_keys: tuple[tuple[str, ...], ...] = ()
    mode: str = "MERGE_ENTITY_PATCH"
    delete_mode: str = "NONE"
    row_id: str = "row_id"
    founding_id: str | None = None
    ephemeral: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    defaults: dict = field(default_factory=dict)
    generated_identity: str | None = None
    f: str = "valid_from"
    u: str = "valid_until"
    to: str | None = None

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}")
        if self.delete_mode not in DELETE_MODES:
            raise ValueError(f"unknown delete mode {self.delete_mode}")
        if not self.identity and not self.natural_keys:
            raise ValueError("an identity or a natural key is needed")
        if set(self.ephemeral) & {self.f, self.u, self.to}:
            raise ValueError("temporal columns can't be ephemeral")

    @property
    def entity(self) -> tuple[str, ...]:
        return tuple(self.identity) or tuple(self.natural_keys[0])

    @property
    def lookup(self) -> list[str]:
        return list(dict.fromkeys(c for key in self.natural_keys for c in key))

    @property
    def portion(self) -> bool:
        return self.mode.endswith("FOR_PORTION_OF")

    @property
    def patch(self) -> bool:
        return self.mode in ("MERGE_ENTITY_PATCH", "PATCH_FOR_PORTION_OF")

    @property
    def last_only(self) -> bool:
        """One source row, the last, answers for a piece."""
        return self.mode in ("MERGE_ENTITY_REPLACE", "INSERT_NEW_ENTITIES", "REPLACE_FOR_PORTION_OF")

    @property
    def deletes_timeline(self) -> bool:
        return "TIMELINE" in self.delete_mode

    @property
    def deletes_entities(self) -> bool:
        """Other entities are only looked at by the merging modes that patch or replace."""
        return self.delete_mode.endswith("ENTITIES") and self.mode in ("MERGE_ENTITY_PATCH", "MERGE_ENTITY_REPLACE")


def _json(columns: list[Column]) -> Column:
    return F.to_json(F.struct(*columns))


def _some(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNotNull() for c in columns], F.lit(False))


def _agree(ours: list[Column], theirs: list[Column]) -> list[Column]:
    """Conditions that keys are the same, where those of one side are never all null. A single column is then compared plainly,
    so that rows which are dealt and sorted by it already need not be again."""
    return [ours[0] == theirs[0]] if len(ours) == 1 else [a.eqNullSafe(b) for a, b in zip(ours, theirs, strict=True)]


class TemporalMerge:
    """A merge of source into target, worked out lazily: plan, target_after, feedback, source_with_identity.

    persist: what becomes of the steps that these share. "memory" caches them until release(), "settled" writes them to the
    shared folder, where they also survive lost executors, and None works them out for each result.
    """

    def __init__(self, target: DataFrame, source: DataFrame, spec: MergeSpec, persist: str | None = None):
        self.target, self.spec = target, spec
        self.kind = target.schema[spec.f].dataType
        needed = [spec.row_id, *([spec.founding_id] if spec.founding_id else [])]
        missing = [c for c in needed if c not in source.columns] + [c for c in (*spec.identity, *spec.lookup, *spec.ephemeral) if c not in target.columns]
        if missing:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        if not set(spec.entity) & set(source.columns) and not any(set(k) <= set(source.columns) for k in spec.natural_keys) and not spec.founding_id and not spec.identity:
            raise ValueError("the source has neither the identity nor a natural key")
        self.source = source
        time = {spec.f, spec.u, spec.to}
        self.payload = [c for c in target.columns if c not in time and c not in spec.identity]
        self.data = [c for c in self.payload if c not in spec.ephemeral]
        self.given = [c for c in self.payload if c in source.columns]
        self._held: list[DataFrame] = []
        self._persist = persist
        self._range: tuple[str, list[str]] | None = None

    # -- who is who -------------------------------------------------------------------------------------------------

    @cached_property
    def rows(self) -> DataFrame:
        """Source rows: _rid, _causal, _f, _u, _e_* (identity), _s_* (payload)."""
        s, spec = self.source, self.spec
        end = F.col(spec.u) if spec.u in s.columns else F.lit(None).cast(self.kind)
        wrong = F.lit(None).cast("string")
        if spec.to and spec.to in s.columns and is_discrete(self.kind):
            after = successor(F.col(spec.to), self.kind)
            wrong = F.when(end.isNotNull() & after.isNotNull() & (end != after), "Source row has inconsistent temporal columns: valid_to and valid_until disagree.")
            end = F.coalesce(end, after)
        if forever(self.kind) is not None:
            end = F.coalesce(end, forever(self.kind))
        causal = F.coalesce(F.col(spec.founding_id).cast("string"), F.col(spec.row_id).cast("string")) if spec.founding_id else F.col(spec.row_id).cast("string")
        types = dict(self.target.dtypes)
        own = lambda c: (F.col(c) if c in s.columns else F.lit(None)).cast(types[c])
        return s.select(
            F.col(spec.row_id).cast("long").alias("_rid"), causal.alias("_causal"), F.col(spec.f).cast(self.kind).alias("_f"), end.cast(self.kind).alias("_u"), wrong.alias("_wrong"),
            *[own(c).alias(f"_e_{c}") for c in spec.entity], *[own(c).alias(f"_l_{c}") for c in spec.lookup], *[F.col(c).cast(types[c]).alias(f"_s_{c}") for c in self.given],
        )

    @cached_property
    def correlated(self) -> DataFrame:
        """rows with _new, _g (the grouping key), _error, and _e_* as found."""
        spec, rows = self.spec, self.rows
        names = [f"_e_{c}" for c in spec.entity]
        found = None
        for key in [tuple(spec.entity), *spec.natural_keys]:
            by_identity = found is None
            ours = [F.col(f"_e_{c}" if by_identity else f"_l_{c}") for c in key]
            if not by_identity and not set(key) & set(self.source.columns):
                continue
            usable = rows.where(_some(ours)).select("_rid", *[c.alias(f"_m_{n}") for c, n in zip(ours, key, strict=True)])
            same = _agree([F.col(f"_m_{c}") for c in key], [F.col(f"_t_{c}") for c in key])
            # the source's keys pick the target's rows, so only what they hit is shuffled further
            asked = usable.drop("_rid").distinct()
            theirs = self.target.select(*[F.col(f"`{c}`").alias(f"_t_{c}") for c in dict.fromkeys([*key, *spec.entity])])
            if by_identity and not spec.natural_keys:
                return self._grouped_by_identity(rows, asked.join(theirs, same, "left_semi"))
            theirs = theirs.join(asked, same, "left_semi").distinct()
            # a key can hit any number of entities, which are not paired with its rows: the first eleven tell what is asked for
            first = theirs.select(*[f"_t_{c}" for c in key], F.struct(*[F.col(f"_t_{c}").alias(c) for c in spec.entity]).alias("_hit"))
            nth = F.row_number().over(Window.partitionBy(*[f"_t_{c}" for c in key]).orderBy("_hit"))
            first = first.withColumn("_nth", nth).where("_nth <= 11").groupBy(*[f"_t_{c}" for c in key]).agg(F.collect_list("_hit").alias("_first"))
            hit = usable.join(first, same).select("_rid", F.lit(0 if by_identity else 1).alias("_by"), "_first")
            found = hit if found is None else found.unionByName(hit)
        hits = found.groupBy("_rid", "_by").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_first")))).alias("_all"))
        hits = hits.select("_rid", "_by", F.size("_all").alias("_n"), F.get("_all", F.lit(0)).alias("_hit"), F.slice("_all", 1, 10).alias("_ten"))
        # a match by identity counts alone; natural keys may find one entity several times
        hits = hits.groupBy("_rid").agg(F.min_by(F.struct("_n", "_hit", "_ten"), "_by").alias("_hits"))
        joined = rows.join(hits, "_rid", "left").withColumn("_new", F.col("_hits").isNull())
        new_identity = [F.when(F.col("_new"), F.col(f"_e_{c}")).otherwise(F.col("_hits._hit")[c]).alias(f"_e_{c}") for c in spec.entity]
        more = F.when(F.col("_hits._n") > 10, ", ...").otherwise("")
        ambiguous = F.concat(F.lit("Source row is ambiguous. It matches multiple distinct target entities: ["), F.array_join(F.transform("_hits._ten", lambda h: F.to_json(h)), ", "), more, F.lit("]"))
        error = F.when(F.col("_wrong").isNotNull(), F.col("_wrong")).when(F.col("_hits._n") > 1, ambiguous)
        if spec.natural_keys and spec.identity and not spec.founding_id:
            nothing = ~_some([F.col(n) for n in names]) & ~_some([F.col(f"_l_{c}") for c in spec.lookup])
            text = f"Source row is unidentifiable. It has NULL for all stable identity columns {{{', '.join(spec.identity)}}} and all natural keys [{', '.join('[' + ', '.join(k) + ']' for k in spec.natural_keys)}]"
            error = error.when(F.col("_new") & nothing, F.lit(text))
        joined = joined.select(*[c for c in rows.columns if c not in names], *new_identity, "_new", error.alias("_error"))
        return self._grouped(joined)

    def _grouped_by_identity(self, rows: DataFrame, there: DataFrame) -> DataFrame:
        """The same where the identity alone finds entities, each of which is hit at most once: those of there (_m_*)."""
        names = [f"_e_{c}" for c in self.spec.entity]
        # dealt anew, so that no task sorts for the look-up and for what follows it, and few of them are broadcast
        hit = there.repartition(F.xxhash64(*[f"_m_{c}" for c in self.spec.entity])).withColumn("_there", F.lit(True))
        joined = rows.join(hit, _agree([F.col(n) for n in names], [F.col(f"_m_{c}") for c in self.spec.entity]), "left")
        return self._grouped(joined.select(*rows.columns, F.col("_there").isNull().alias("_new"), F.col("_wrong").alias("_error")))

    def _grouped(self, joined: DataFrame) -> DataFrame:
        """joined with _g, the key of its entity: one of the target, or a new one."""
        spec = self.spec
        identity = _json([F.col(f"_e_{c}").alias(c) for c in spec.entity])
        existing = F.concat(F.lit("existing_entity__"), identity)
        if spec.founding_id:
            fresh = F.concat(F.lit("new_entity__"), F.col("_causal"))
        else:
            by_identity = F.when(_some([F.col(f"_e_{c}") for c in spec.entity]), F.concat(F.lit("new_entity__"), identity))
            fresh = F.coalesce(by_identity, F.concat(F.lit("new_entity__row_"), F.col("_causal")))
            if spec.natural_keys:
                joined = self._natural_groups(joined)
                fresh = F.coalesce(F.col("_natural"), fresh)
        return joined.withColumn("_g", F.when(F.col("_new"), fresh).otherwise(existing)).drop("_natural", "_wrong")

    def _natural_groups(self, joined: DataFrame) -> DataFrame:
        """joined with _natural for new rows with some natural key: rows that share a key, or are linked by others that do, are
        of one group."""
        spec = self.spec
        keys = [k for k in spec.natural_keys if set(k) & set(self.source.columns)]
        if len(keys) == 1:
            columns = [F.col(f"_l_{c}").alias(c) for c in keys[0]]
            return joined.withColumn("_natural", F.when(F.col("_new") & _some([F.col(f"_l_{c}") for c in keys[0]]), F.concat(F.lit("new_entity__"), _json(columns))))
        values = [F.when(_some([F.col(f"_l_{c}") for c in key]), F.concat(F.lit(f"{i}:"), _json([F.col(f"_l_{c}").alias(c) for c in key]))) for i, key in enumerate(keys)]
        held = joined.where("_new").select("_rid", F.explode(F.array_compact(F.array(*values))).alias("_value"))
        first = held.groupBy("_value").agg(F.min("_rid").alias("_first"))
        edges = held.join(first, "_value").select(F.col("_rid").alias("a"), F.col("_first").alias("b"))
        roots = components(edges)
        alone = held.select("_rid").distinct().join(roots, F.col("_rid") == F.col("node"), "left")
        return joined.join(alone.select("_rid", F.concat(F.lit("new_entity__key_"), F.coalesce("root", "_rid").cast("string")).alias("_natural")), "_rid", "left")

    @cached_property
    def judged(self) -> DataFrame:
        """correlated with _skip: null for the rows that take part."""
        spec, rows = self.spec, self.correlated
        if spec.lookup or spec.founding_id:
            rows = self._eclipsed(rows)
        else:
            rows = rows.withColumn("_eclipsed", F.lit(None).cast("boolean"))
        skip = F.when(F.col("_error").isNotNull(), "ERROR")
        if spec.mode == "INSERT_NEW_ENTITIES":
            skip = skip.when(~F.col("_new"), "SKIP_FILTERED")
        if spec.portion:
            skip = skip.when(F.col("_new"), "SKIP_NO_TARGET")
        return self._hold(rows.withColumn("_skip", skip.when(F.coalesce("_eclipsed", F.lit(False)), "SKIP_ECLIPSED")).drop("_eclipsed"))

    def _eclipsed(self, rows: DataFrame) -> DataFrame:
        """rows with _eclipsed: later rows of their key cover their whole period, no piece of it has the row as its latest."""
        live = F.coalesce(F.col("_error").isNull() & (F.col("_f") < F.col("_u")), F.lit(False))
        keys = [F.col(f"_l_{c}").alias(c) for c in self.spec.lookup]
        part = F.coalesce(F.when(_some([F.col(f"_l_{c}") for c in self.spec.lookup]), _json(keys)), F.col("_causal")) if keys else F.col("_causal")
        # rows that don't count hang together with none
        marked = rows.withColumns({"_live": live, "_part": F.when(live, part).otherwise(F.concat(F.lit("row "), F.col("_rid").cast("string")))})
        marked = marked.repartition("_part").sortWithinPartitions("_part")
        return marked.mapInArrow(sweep.eclipsed(), StructType([*rows.schema.fields, StructField("_eclipsed", BooleanType())]))

    # -- the new history --------------------------------------------------------------------------------------------

    @cached_property
    def _touched(self) -> DataFrame:
        """The identities that the source names, those of the target's entities among them. Where natural keys find entities
        these alone; otherwise it is for the join to tell which are there."""
        names = [F.col(f"_e_{c}") for c in self.spec.entity]
        named = self.judged.where("not _new") if self.spec.natural_keys else self.judged.where(_some(names))
        return named.select(*[n.alias(f"_k_{c}") for n, c in zip(names, self.spec.entity, strict=True)]).distinct()

    def _of_touched(self, how: str) -> DataFrame:
        theirs, ours = [F.col(f"`{c}`") for c in self.spec.entity], [F.col(f"_k_{c}") for c in self.spec.entity]
        # an entity that a natural key finds may have no identity at all
        same = [a.eqNullSafe(b) for a, b in zip(theirs, ours, strict=True)] if self.spec.natural_keys else _agree(theirs, ours)
        return self.target.join(self._touched, same, how)

    @cached_property
    def _scope(self) -> DataFrame:
        """Target rows of the entities that the merge looks at."""
        spec = self.spec
        rows = self.target if spec.deletes_entities else self._of_touched("left_semi")
        key = F.concat(F.lit("existing_entity__"), _json([F.col(f"`{c}`").alias(c) for c in spec.entity]))
        return self._hold(rows.select(key.alias("_g"), F.col(spec.f).alias("_tf"), F.col(spec.u).alias("_tu"), *[F.col(f"`{c}`").alias(f"_e_{c}") for c in spec.entity], *[F.col(f"`{c}`").alias(f"_t_{c}") for c in self.payload]))

    @cached_property
    def _active(self) -> DataFrame:
        return self.judged.where("_skip is null and _f < _u")

    def _swept(self, named: bool) -> DataFrame:
        """The pieces of the history with the rows that answer for them (see sweep.pieces)."""
        spec, kinds = self.spec, dict(self.target.dtypes)
        kept_old = [c for c in self.given if c not in spec.ephemeral and (spec.patch or c in spec.required)]
        entity = [F.col(f"_e_{c}") for c in spec.entity]
        value = lambda c: F.col(f"_s_{c}") if c in self.given else F.lit(None).cast(kinds[c])
        ours = self._active.select("_g", F.lit(False).alias("_target"), "_rid", "_f", "_u", "_causal", *entity, *[value(c).alias(f"_v_{c}") for c in self.payload])
        theirs = self._scope.select("_g", F.lit(True).alias("_target"), F.lit(None).cast("long").alias("_rid"), F.col("_tf").alias("_f"), F.col("_tu").alias("_u"), F.lit(None).cast("string").alias("_causal"), *entity, *[F.col(f"_t_{c}").alias(f"_v_{c}") for c in self.payload])
        rows = ours.unionByName(theirs).where("_f < _u").repartition("_g").sortWithinPartitions("_g")
        kind = self.kind.simpleString()
        schema = f"_g string, _p {kind}, _n {kind}, _sourced boolean, _tf {kind}, _tu {kind}, _last long, _lf {kind}, _lu {kind}, _by string, _next_to long, _first_rid long, _cause string, _is_new boolean"
        fields = [*[(f"_e_{c}", kinds[c]) for c in spec.entity], *[(f"_s_{c}", kinds[c]) for c in self.given], *[(f"_t_{c}", kinds[c]) for c in self.payload]]
        schema += "".join(f", `{name}` {kind}" for name, kind in fields) + ", _ids array<long>" * named
        return rows.mapInArrow(sweep.pieces(list(spec.entity), self.payload, self.given, kept_old, named), schema)

    def _marked(self, named: bool = False) -> DataFrame:
        """The pieces of the new history, with the block that each belongs to. named: also the source rows behind each (_ids):
        those that cover it (the last alone in modes where it answers), or for a piece of the target alone one beside it."""
        spec, found = self.spec, self._swept(named and not self.spec.last_only)
        targeted = F.col("_tf").isNotNull()
        found = found.withColumns({"_targeted": targeted, "_entity_active": F.col("_first_rid").isNotNull()})
        if spec.portion:
            found = found.where("_targeted" if spec.mode != "DELETE_FOR_PORTION_OF" else "_targeted and not _sourced")
        if spec.deletes_timeline:
            found = found.where("_sourced or not _entity_active")
        if spec.deletes_entities:
            found = found.where("_entity_active")
        beside = F.when(F.col("_entity_active"), F.coalesce("_next_to", "_first_rid"))
        behind = F.when(F.col("_last").isNotNull(), F.array("_last") if spec.last_only else F.col("_ids")).when(beside.isNotNull(), F.array(beside))
        found = found.select(
            "_g", "_p", "_n", "_sourced", "_tf", "_cause", "_by", "_is_new", *([behind.alias("_ids")] if named else []),
            F.when(F.col("_sourced") & targeted, allen(F.col("_lf"), F.col("_lu"), F.col("_tf"), F.col("_tu"))).alias("_st"),
            *[F.col(f"`_e_{c}`") for c in spec.entity], *[self._value(c).alias(f"_c_{c}") for c in self.payload])
        found, own = dealt(found, "_g"), Window.partitionBy("_g").orderBy("_p")
        same = F.lag("_n").over(own) == F.col("_p")
        for c in self.data:
            same = same & F.lag(self._comparable(f"_c_{c}")).over(own).eqNullSafe(self._comparable(f"_c_{c}"))
        found = found.withColumn("_start", F.when(same, 0).otherwise(1))
        return found.withColumn("_block", F.sum("_start").over(own.rowsBetween(Window.unboundedPreceding, 0)))

    def _coalesced(self) -> DataFrame:
        """The coalesced pieces, as far as a snapshot needs them: _g, _f, _u, _inserted (no piece is of a target row), _e_*, _c_*.

        All of it goes by one order. The first and the last piece of a block follow each other once those between are left out.
        """
        own = Window.partitionBy("_g").orderBy("_p")
        old = F.max(F.when(F.col("_tf").isNotNull(), F.col("_block"))).over(own.rowsBetween(Window.unboundedPreceding, 0))
        found = self._marked().withColumns({"_end": F.coalesce(F.lead("_start").over(own), F.lit(1)), "_old": old}).where("_start = 1 or _end = 1")
        at_end = lambda c: F.when(F.col("_end") == 1, F.col(c)).otherwise(F.lead(c).over(own))
        found = found.withColumns({"_u": at_end("_n"), "_inserted": ~at_end("_old").eqNullSafe(F.col("_block")), **{f"_c_{c}": at_end(f"_c_{c}") for c in self.payload if c in self.spec.ephemeral}})
        values = [f"_e_{c}" for c in self.spec.entity] + [f"_c_{c}" for c in self.payload]
        return found.where("_start = 1").select("_g", F.col("_p").alias("_f"), "_u", "_inserted", *[F.col(f"`{c}`") for c in values])

    def _resolved(self, named: bool = False) -> DataFrame:
        """The coalesced pieces, one row for each block: _g, _block, _f, _u, _from (start of the target row that it comes from),
        _e_*, _c_* payload, ... and with `named` row_ids, the source rows behind it."""
        # a block's values are those of its first piece, which is kept, its ephemeral ones those of its last
        whole = Window.partitionBy("_g", "_block").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first_of = lambda c: F.first(c, ignorenulls=True).over(whole)
        blocks = self._marked(named).withColumns({
            "_u": F.max("_n").over(whole), "_from": first_of("_tf"), "_sourced": F.max("_sourced").over(whole), "s_t_relation": first_of("_st"), "_by": first_of("_by"), **{f"_c_{c}": F.last(f"_c_{c}").over(whole) for c in self.payload if c in self.spec.ephemeral},
            **({"row_ids": F.collect_list("_ids").over(whole)} if named else {})}).where("_start = 1")
        values = [f"_e_{c}" for c in self.spec.entity] + [f"_c_{c}" for c in self.payload]
        ids = [F.array_sort(F.array_distinct(F.flatten("row_ids"))).alias("row_ids")] if named else []
        return blocks.select("_g", "_block", F.col("_p").alias("_f"), "_u", "_from", "_sourced", "s_t_relation", "_cause", "_by", "_is_new", *ids, *[F.col(f"`{c}`") for c in values])

    def _comparable(self, name: str) -> Column:
        column = name.removeprefix("_c_").removeprefix("_t_")
        return F.to_json(name) if "map<" in dict(self.target.dtypes)[column] else F.col(name)

    def _value(self, c: str) -> Column:
        old, new = F.col(f"_t_{c}"), F.col(f"_s_{c}")
        if c not in self.given:
            return old
        if c in self.spec.lookup or self.spec.patch or c in self.spec.required:
            return F.when(F.col("_sourced"), F.coalesce(new, old)).otherwise(old)
        return F.when(F.col("_sourced"), new).otherwise(old)

    @cached_property
    def _numbers(self) -> DataFrame:
        """_g of new entities without an identity, and the number that they get; in the order of their first source rows."""
        name, spec = f"_e_{self.spec.generated_identity}", self.spec
        new = self._active.where("_new").groupBy("_g").agg(F.max(name).alias("_given"), F.min("_rid").alias("_first"))
        start = self.target.agg(F.max(spec.generated_identity)).first()[0] or 0
        given = new.agg(F.max("_given")).first()[0] or 0
        numbered = _numbered(new.where("_given is null"), "_first", "_g")
        return self._hold(numbered.select("_g", (F.col("_number") + F.lit(max(start, given))).cast(dict(self.target.dtypes)[spec.generated_identity]).alias("_made")))

    def _identified(self, rows: DataFrame) -> DataFrame:
        """rows (with _g and _e_*) with the generated identity filled in."""
        if not self.spec.generated_identity:
            return rows
        name = f"_e_{self.spec.generated_identity}"
        return rows.join(self._numbers, "_g", "left").withColumn(name, F.coalesce(F.col(name), F.col("_made"))).drop("_made")

    @cached_property
    def target_after(self) -> DataFrame:
        """The new snapshot: the target's columns, entities out of scope as they were."""
        if self._range is None:
            return self._after
        name, columns = self._range
        period = F.struct(F.col(self.spec.f).alias("lower"), F.col(self.spec.u).alias("upper")).alias(name)
        return self._after.select(*[period if c == name else F.col(f"`{c}`") for c in columns])

    @cached_property
    def _after(self) -> DataFrame:
        spec = self.spec
        rows = self._identified(self._coalesced())
        value = lambda c: F.when(F.col("_inserted") & F.col(f"_c_{c}").isNull(), F.lit(spec.defaults[c])).otherwise(F.col(f"_c_{c}")) if c in spec.defaults else F.col(f"_c_{c}")
        parts = {c: value(c) for c in self.payload} | {spec.f: F.col("_f"), spec.u: F.col("_u")} | {c: F.col(f"_e_{c}") for c in spec.entity}
        if spec.to:
            parts[spec.to] = predecessor(F.col("_u"), self.kind)
        made = rows.select(*[parts[c].cast(dict(self.target.dtypes)[c]).alias(c) for c in self.target.columns])
        if spec.deletes_entities:
            return made
        rest = self._of_touched("left_anti").select(*[F.col(f"`{c}`") for c in self.target.columns])
        return rest.unionByName(made)

    # -- what was done ----------------------------------------------------------------------------------------------

    @cached_property
    def plan(self) -> DataFrame:
        """One row for each operation and for each source row that takes no part.

        statement_seq, row_ids, operation, update_effect, causal_id, is_new_entity, the identity, s_t_relation,
        b_a_relation, old_valid_from, old_valid_until, new_valid_from, new_valid_until, the payload, feedback,
        grouping_key. Deletions name the source rows that overlap what they delete. ordered_plan() numbers the rows.
        """
        spec = self.spec
        kinds = dict(self.target.dtypes)
        nothing = lambda c, k: F.lit(None).cast(k).alias(c)
        left_out = self.judged.where("_skip is not null").select(
            F.array("_rid").alias("row_ids"), F.col("_skip").alias("operation"), nothing("update_effect", "string"), F.col("_causal").alias("causal_id"), F.col("_new").alias("is_new_entity"),
            *[F.col(f"_e_{c}").alias(c) for c in spec.entity], nothing("s_t_relation", "string"), nothing("b_a_relation", "string"),
            *[nothing(c, self.kind) for c in ("old_valid_from", "old_valid_until", "new_valid_from", "new_valid_until")],
            *[nothing(c, kinds[c]) for c in self.payload if c not in spec.entity], F.col("_error").alias("feedback"), F.col("_g").alias("grouping_key"))
        order = F.when(F.col("operation") == "DELETE", 1).when(F.col("operation") == "UPDATE", F.when(F.col("update_effect").isin("NONE", "SHRINK"), 2).when(F.col("update_effect") == "MOVE", 3).otherwise(4)).when(F.col("operation") == "INSERT", 5).otherwise(6)
        return self._operations.unionByName(left_out).withColumn("statement_seq", order)

    @cached_property
    def _operations(self) -> DataFrame:
        """The operations of the plan, without the source rows that take no part and without statement_seq."""
        spec = self.spec
        t = self._scope.withColumnsRenamed({f"_e_{c}": f"_te_{c}" for c in spec.entity})
        blocks = self._hold(self._identified(self._resolved(named=True)))
        # a block comes from one target row, with which it is compared, or from none; rows of both sides are dealt once
        based = blocks.where("_from is not null").withColumnRenamed("_g", "_bg")
        from_it = (F.col("_g") == F.col("_bg")) & (F.col("_tf") == F.col("_from"))
        both = t.join(based, from_it, "left")
        equal = lambda columns: reduce(lambda a, b: a & b, [self._comparable(f"_c_{c}").eqNullSafe(self._comparable(f"_t_{c}")) for c in columns], F.lit(True))
        both = both.withColumns({"_same_data": equal(self.data), "_same_all": equal(self.payload)})
        own = Window.partitionBy("_g", "_tf").orderBy((F.col("_f") == F.col("_tf")).desc(), F.col("_same_data").desc(), "_f", "_u")
        both = both.withColumn("_rank", F.row_number().over(own))
        operation = (
            F.when(F.col("_f").isNull(), "DELETE")
            .when(F.col("_rank") > 1, "INSERT")
            .when((F.col("_f") == F.col("_tf")) & (F.col("_u") == F.col("_tu")) & F.col("_same_all"), "SKIP_IDENTICAL")
            .otherwise("UPDATE")
        )
        both = both.withColumn("operation", operation).where("operation <> 'SKIP_IDENTICAL' or _sourced")
        f, u, tf, tu = (F.col(c) for c in ("_f", "_u", "_tf", "_tu"))
        effect = F.when(F.col("operation") == "UPDATE", F.when((f == tf) & (u == tu), "NONE").when((f >= tf) & (u <= tu), "SHRINK").when((f <= tf) & (u >= tu), "GROW").otherwise("MOVE"))
        over = self._active.select(F.col("_g").alias("_og"), F.col("_f").alias("_of"), F.col("_u").alias("_ou"), F.col("_rid").alias("_orid"))
        # a row that only takes away covers nothing that is left, so what changes names the rows that overlap what was there
        taking = spec.mode == "DELETE_FOR_PORTION_OF"
        changed = (t if taking else t.join(based, from_it, "left_anti")).select("_g", "_tf", "_tu").distinct()
        gone = changed.join(over, (F.col("_g") == F.col("_og")) & (F.col("_of") < F.col("_tu")) & (F.col("_ou") > F.col("_tf")))
        gone = gone.groupBy("_g", "_tf").agg(F.array_sort(F.collect_set("_orid")).alias("_gone"))
        none = F.array().cast("array<long>")
        named = F.coalesce("_gone", none) if taking else F.coalesce("row_ids", "_gone", none)
        both = both.join(gone, ["_g", "_tf"], "left")
        both = both.unionByName(blocks.where("_from is null").withColumn("operation", F.lit("INSERT")), allowMissingColumns=True)
        both = both.withColumns({"row_ids": named, "_is_new": F.coalesce("_is_new", F.lit(False)), **{f"_e_{c}": F.coalesce(f"_te_{c}", f"_e_{c}") for c in spec.entity}})
        done = both.withColumn("update_effect", effect)
        keep = lambda c: F.when(F.col("operation") == "DELETE", F.col(f"_t_{c}")).otherwise(F.col(f"_c_{c}"))
        done = done.select(
            "row_ids", "operation", "update_effect", F.when(F.col("_is_new"), F.coalesce("_by", "_cause")).otherwise(F.col("_cause")).alias("causal_id"), F.col("_is_new").alias("is_new_entity"),
            *[F.col(f"_e_{c}").alias(c) for c in spec.entity], "s_t_relation", F.when(tf.isNotNull() & f.isNotNull(), allen(f, u, tf, tu)).alias("b_a_relation"),
            tf.alias("old_valid_from"), tu.alias("old_valid_until"), f.alias("new_valid_from"), u.alias("new_valid_until"),
            *[keep(c).alias(c) for c in self.payload if c not in spec.entity], F.lit(None).cast("string").alias("feedback"), F.col("_g").alias("grouping_key"))
        # one join away from the settled blocks and target rows, so a result that needs a few of its columns reads just these
        return done if self._persist == "settled" else self._hold(done)

    def ordered_plan(self) -> DataFrame:
        """plan, sorted, with plan_op_seq."""
        from tidemark.operators.ordering import global_rank

        order = [F.col("statement_seq"), F.col("grouping_key"), F.coalesce("new_valid_from", "old_valid_from"), F.col("row_ids")]
        return global_rank(self.plan, order, "plan_op_seq").withColumn("plan_op_seq", F.col("plan_op_seq") + 1).orderBy("plan_op_seq")

    @cached_property
    def feedback(self) -> DataFrame:
        """source_row_id, target_entity_keys (JSON, sorted), status and error_message: one row for each source row."""
        entity = self.spec.entity
        ops = self._operations.select(F.explode("row_ids").alias("_rid"), (F.col("operation") != "SKIP_IDENTICAL").alias("_does"), _json([F.col(c) for c in entity]).alias("_key"))
        seen = ops.groupBy("_rid").agg(F.max("_does").alias("_does"), F.array_sort(F.collect_set("_key")).alias("_keys"))
        done = F.when(F.col("_does").isNull(), "ERROR").when(F.col("_does"), "APPLIED").otherwise("SKIPPED_IDENTICAL")
        rows = self.judged.where("_skip is null").select("_rid").join(seen, "_rid", "left")
        rows = rows.select("_rid", F.coalesce("_keys", F.array().cast("array<string>")).alias("_keys"), done.alias("_status"), F.when(F.col("_does").isNull(), NO_PLAN).alias("_text"))
        # rows that take no part are in no operation: what became of them is known before there is one
        skipped = F.when(F.col("_skip") == "ERROR", "ERROR").when(F.col("_skip") == "SKIP_NO_TARGET", "SKIPPED_NO_TARGET").when(F.col("_skip") == "SKIP_FILTERED", "SKIPPED_FILTERED").otherwise("SKIPPED_ECLIPSED")
        left_out = self.judged.where("_skip is not null").select("_rid", F.array(_json([F.col(f"_e_{c}").alias(c) for c in entity])).alias("_keys"), skipped.alias("_status"), F.col("_error").alias("_text"))
        return rows.unionByName(left_out).select(F.col("_rid").alias("source_row_id"), F.col("_keys").alias("target_entity_keys"), F.col("_status").alias("status"), F.col("_text").alias("error_message"))

    @cached_property
    def source_with_identity(self) -> DataFrame:
        """The source with the identity of its entities filled in, generated ones included."""
        names = [f"_e_{c}" for c in self.spec.entity]
        new = self._active.where("_new").groupBy("_g").agg(*[F.expr(f"max_by(`{n}`, _rid) filter (where `{n}` is not null)").alias(n) for n in names])
        new = self.judged.where("_new").select("_rid", "_g").join(self._identified(new), "_g")
        ids = self.judged.where("not _new and _error is null").select("_rid", *names).unionByName(new.select("_rid", *names))
        joined = self.source.join(ids, F.col(self.spec.row_id).cast("long") == F.col("_rid"), "left")
        kept = [c for c in self.source.columns if c not in self.spec.entity]
        filled = [F.coalesce(F.col(f"_e_{c}"), *([F.col(c)] if c in self.source.columns else [])).alias(c) for c in self.spec.entity]
        return joined.select(*kept, *filled)

    def source_with_feedback(self, status: str = "merge_status", error: str = "merge_error") -> DataFrame:
        told = self.feedback.select(F.col("source_row_id").alias("_rid"), F.col("status").alias(status), F.col("error_message").alias(error))
        return self.source.drop(status, error).join(told, F.col(self.spec.row_id).cast("long") == F.col("_rid"), "left").drop("_rid")

    def release(self) -> None:
        """Let the steps go that persist="memory" keeps."""
        for df in self._held:
            df.unpersist()

    def _hold(self, df: DataFrame) -> DataFrame:
        """df, kept as asked for, as several results need it."""
        if self._persist == "settled":
            return settled(df)
        if self._persist == "memory":
            self._held.append(df.persist())
        return df


def _numbered(rows: DataFrame, order: str, tie: str) -> DataFrame:
    from tidemark.operators.ordering import global_rank

    ranked = global_rank(rows, [F.col(order), F.col(tie)], "_number")
    return ranked.withColumn("_number", F.col("_number") + 1)


def temporal_merge(target: DataFrame, source: DataFrame, persist: bool | str = True, range_column: str | None = None, **spec) -> TemporalMerge:
    """Merge source into target; the keywords are those of MergeSpec. persist: "memory" (or True) caches the steps that the
    results share until release(), "settled" writes them to the shared folder, False works them out again for each result,
    which is best where only target_after is wanted. range_column: a struct (lower, upper) that holds the target's period,
    alone or beside boundary columns, which then follow it; the source has the same struct or the boundary columns."""
    spec = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in spec.items()}
    if persist not in (True, False, "memory", "settled"):
        raise ValueError(f"unknown way to persist: {persist}")
    columns, known = target.columns, MergeSpec(**spec)
    if range_column:
        bounds = {known.f: F.col(range_column)["lower"], known.u: F.col(range_column)["upper"]}
        target, source = (df.withColumns(bounds).drop(range_column) if range_column in df.columns else df for df in (target, source))
    merge = TemporalMerge(target, source, known, {True: "memory", False: None}.get(persist, persist))
    merge._range = (range_column, columns) if range_column else None
    return merge
