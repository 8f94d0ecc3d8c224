"""The merge against a day-by-day evaluation, over random histories of a few entities."""

import random
from datetime import date, timedelta

import pytest

from tidemark.operators.merge import MODES, temporal_merge

START = date(2024, 1, 1)
DAYS = 24
TARGET = "id int, a string, b string, c string, valid_from date, valid_until date"


def day(n):
    return START + timedelta(n)


def histories(r):
    """Non-overlapping target rows and arbitrary source rows for a dozen entities."""
    target, source = [], []
    for i in range(12):
        at = 0
        while i < 9 and at < DAYS:
            end = at + r.randint(1, 6)
            if r.random() < 0.7:
                target.append((i, r.choice("xy"), r.choice(["p", None]), r.choice("12"), day(at), day(end)))
            at = end
        for _ in range(r.randint(0, 4)):
            f = r.randrange(DAYS)
            source.append((len(source), i, r.choice(["x", "y", None]), r.choice(["p", "q", None]), r.choice("34"), day(f), day(f + r.randint(0, 8))))
    return target, source


def by_day(rows):
    return {(i, d): (a, b) for i, a, b, _, f, u in rows for d in range((f - START).days, (u - START).days)}


def evaluate(target, source, mode, delete_mode):
    old, known = by_day(target), {r[0] for r in target}
    portion, patch = mode.endswith("PORTION_OF"), "PATCH" in mode
    active = [s for s in source if s[5] < s[6] and (s[1] in known if portion else s[1] not in known if mode == "INSERT_NEW_ENTITIES" else True)]
    present = {s[1] for s in active}
    out = {}
    for i in range(12):
        for d in range(DAYS + 10):
            base = old.get((i, d))
            over = [s for s in active if s[1] == i and s[5] <= day(d) < s[6]]
            if portion and base is None:
                continue
            if over and mode == "DELETE_FOR_PORTION_OF":
                continue
            value = base
            for s in over:
                value = tuple(n if n is not None or not patch else o for n, o in zip(s[2:4], value or (None, None), strict=True))
            if not over and (("TIMELINE" in delete_mode and i in present) or (delete_mode.endswith("ENTITIES") and i not in present and mode in ("MERGE_ENTITY_PATCH", "MERGE_ENTITY_REPLACE"))):
                continue
            if value is not None:
                out[i, d] = value
    return out


@pytest.mark.parametrize("seed,mode,delete_mode", [(k, m, "NONE") for k, m in enumerate(MODES)] + [(20, "MERGE_ENTITY_PATCH", "DELETE_MISSING_TIMELINE_AND_ENTITIES"), (21, "MERGE_ENTITY_REPLACE", "DELETE_MISSING_ENTITIES")])
def test_merge_matches_days(spark, seed, mode, delete_mode):
    target, source = histories(random.Random(seed))
    merge = temporal_merge(spark.createDataFrame(target, TARGET), spark.createDataFrame(source, "row_id int, " + TARGET), identity=["id"], mode=mode, delete_mode=delete_mode, ephemeral=["c"], persist=True)
    after = [tuple(r) for r in merge.target_after.collect()]
    assert by_day(after) == evaluate(target, source, mode, delete_mode)
    assert len(by_day(after)) == sum((u - f).days for *_, f, u in after)  # no overlaps
    touched = {s[1] for s in source}
    ordered = sorted(after, key=lambda r: (r[0], r[4]))
    assert not [1 for x, y in zip(ordered, ordered[1:], strict=False) if x[0] == y[0] in touched and x[5] == y[4] and x[1:3] == y[1:3] and mode not in ("INSERT_NEW_ENTITIES",)]  # neighbours differ
    plan = merge.plan.collect()
    kept = {(r["id"], r["old_valid_from"]) for r in plan if r["operation"] in ("DELETE", "UPDATE")}
    replayed = [(r[0], r[4], r[5]) for r in target if (r[0], r[4]) not in kept] + [(r["id"], r["new_valid_from"], r["new_valid_until"]) for r in plan if r["operation"] in ("INSERT", "UPDATE")]
    assert sorted(replayed) == sorted((r[0], r[4], r[5]) for r in after)
    assert sorted(r["source_row_id"] for r in merge.feedback.collect()) == [s[0] for s in source]
    merge.release()


def test_batches_give_the_same_state(spark):
    target, source = histories(random.Random(77))
    one = temporal_merge(spark.createDataFrame(target, TARGET), spark.createDataFrame(source, "row_id int, " + TARGET), identity=["id"], ephemeral=["c"])
    state = spark.createDataFrame(target, TARGET)
    for part in (source[:8], source[8:]):
        state = spark.createDataFrame([tuple(r) for r in temporal_merge(state, spark.createDataFrame(part, "row_id int, " + TARGET), identity=["id"], ephemeral=["c"]).target_after.collect()], TARGET)
    assert by_day(map(tuple, one.target_after.collect())) == by_day(map(tuple, state.collect()))
