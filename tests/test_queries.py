"""Every query of the catalogue against DuckDB."""

import pytest

from graphloom.plans.oracle import BOUNDS, ORACLE
from graphloom.plans.queries import QUERIES
from graphloom.sources.star import part_chain


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(BOUNDS))
def test_one_round_more_of_the_sql_changes_nothing(name, duck):
    assert duck.sql(BOUNDS[name]).fetchall() == [(0,)]


def test_whole_frontiers_expand_every_edge(spark, sf_dir):
    edges = part_chain(spark, sf_dir).edges.select("src", "dst").collect()
    assert sorted(QUERIES["frontier_v2e_all"](spark, sf_dir).collect()) == sorted(edges)
    assert {r.id for r in QUERIES["frontier_e2v_all"](spark, sf_dir).collect()} == {r.dst for r in edges}
