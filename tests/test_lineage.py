"""Lineage operators on random broken forests and on one very long line."""

import random

import pytest
from pyspark.sql import functions as F

from cellframe.operators import lineage as l

SCHEMA = ("cell_id long, parent_id long, child1_id long, child2_id long, birth_label int, birth_time int, division_time int, "
          "fov int, peak int, sb double, sd double")


def forest(seed, n=80, keep=0.8):
    rng, rows = random.Random(seed), {}
    kids = {}
    for i in range(n):
        free = [p for p in range(i) if len(kids.get(p, [])) < 2]
        p = rng.choice(free) if free and rng.random() < 0.9 else None
        if p is not None:
            kids.setdefault(p, []).append(i)
        rows[i] = p
    out = []
    for i, p in rows.items():
        c = (kids.get(i, []) + [10_000 + i, 20_000 + i])[:2]
        out.append((i, p, c[0], c[1], rng.randint(1, 3), i, i + 5, 1, i % 3, 1.0, 2.0))
    return [r for r in out if rng.random() < keep]


def up(cells, i):
    out = []
    while cells[i][1] in cells:
        i = cells[i][1]
        out.append(i)
    return out


def down(cells, i):
    while cells[i][2] in cells:
        i = cells[i][2]
    return i


@pytest.fixture(scope="module", params=range(2))
def world(request, spark):
    rows = forest(request.param)
    return {r[0]: r for r in rows}, spark.createDataFrame(rows, SCHEMA)


def test_walks(world):
    cells, df = world
    got = {(r.cell_id, r.ancestor_id): r.steps for r in l.ancestors(df).collect()}
    assert got == {(i, a): k + 1 for i in cells for k, a in enumerate(up(cells, i))}
    assert {r.cell_id: r.generations for r in l.generation_gap(df).collect()} == {i: len(up(cells, i)) for i in cells}
    assert {r.cell_id: r.last_id for r in l.last_daughter(df).collect()} == {i: down(cells, i) for i in cells}


@pytest.mark.parametrize("n_gens, ends", [(0, False), (2, False), (3, True)])
def test_lineages_of_length(world, n_gens, ends):
    cells, df = world
    want = set()
    for i in cells:
        chain = [down(cells, i), *up(cells, down(cells, i))]
        if len(chain) - 1 >= n_gens:
            want |= set(chain[1:-1] if ends else chain)
    got = {r.cell_id for r in l.lineages_of_length(df, n_gens=n_gens, remove_ends=ends).collect()}
    assert got == want
    if n_gens == 0:
        assert got == set(cells)


def test_pole_age(world):
    cells, df = world
    age = {}

    def go(i, side):
        a, b = age[cells[i][1]]
        age[i] = (a + 1, 0) if side == 0 else (0, b + 1)
        for s in (0, 1):
            c = cells[i][2 + s]
            if c in cells and cells[c][4] != 1:
                go(c, s)

    for i, r in cells.items():
        if r[4] == 1:
            age[i] = (1000, 0)
    for i, r in cells.items():
        if r[4] == 1 and r[3] in cells and cells[r[3]][4] != 1:
            go(r[3], 1)
    got = {r.cell_id: (r.pole_closed, r.pole_open) for r in l.pole_age(df).collect()}
    assert got == {i: age.get(i, (None, None)) for i in cells}


def test_one_long_line(spark):
    n = 700
    rows = [(i, i - 1 if i else None, i + 1, 10_000 + i, 1, i, i + 1, 1, 0, 1.0, 2.0) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.cell_id: r.generations for r in l.generation_gap(df).collect()}
    assert got == {i: i for i in range(n)}
    assert {r.last_id for r in l.last_daughter(df).collect()} == {n - 1}
    chain = l.mother_lineages(df)
    assert chain.count() == n and chain.agg(F.max("length")).first()[0] == n
    # every birth in the channel follows a division
    assert l.connectors(df).count() == n - 1


def test_cycles_are_an_error(spark):
    """Two cells that are each other's parent; superseded rounds are removed."""
    rows = [(1, 2, 2, None, 1, 0, 1, 1, 0, 1.0, 2.0), (2, 1, 1, None, 1, 1, 2, 1, 0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for walk in (l.generation_gap, l.last_daughter, l.ancestors, lambda c: l.lineages_of_length(c, n_gens=0)):
        with pytest.raises(ValueError, match="cycle"):
            walk(df).count()


def test_superseded_rounds_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("cellframe.functions.lineage_cut.shared_dir", lambda spark: str(tmp_path))
    n = 300
    df = spark.createDataFrame([(i, i - 1 if i else None, i + 1, 10_000 + i, 1, i, i + 1, 1, 0, 1.0, 2.0) for i in range(n)], SCHEMA)
    assert l.generation_gap(df).count() == n
    assert len(list(tmp_path.glob("round-*"))) == 1


def test_rounds_write_lists_not_pairs(spark, monkeypatch):
    """Ancestors double as one row per cell; a length needs as many jumps as it has bits, not the whole depth."""
    rows = [(i, i - 1 if i else None, i + 1) for i in range(40)]
    df = spark.createDataFrame(rows, "cell_id long, parent_id long, child1_id long")
    lists = l.ancestor_lists(df)
    assert {r.cell_id: r.up for r in lists.collect()} == {i: list(range(i - 1, -1, -1)) for i in range(40)}
    assert l.ancestors(df).count() == 40 * 39 // 2
    monkeypatch.setattr(l, "resolve", None)
    for n in (5, 40):
        assert l.lineages_of_length(df, n_gens=n).count() == (40 if n < 40 else 0)
