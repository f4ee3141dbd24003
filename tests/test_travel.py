"""What a query on roads asks for: no more nodes, columns or tables than its answer needs."""

from __future__ import annotations

from accessgeo.operators import network, paths
from accessgeo.plans import impact, queries

SF_DIR = "/root/testdata/sf0.001"


def test_summary_needs_no_whole_links(spark, monkeypatch):
    told = tuple(queries.road_summary(spark, SF_DIR).first())
    monkeypatch.setattr(network, "build_links", lambda *_: (_ for _ in ()).throw(AssertionError("all columns of all links")))
    assert tuple(queries.road_summary(spark, SF_DIR).first()) == told and told[0] > 0


def test_components_of_damaged_links_are_asked_for_places_and_lost_links(spark, monkeypatch):
    asked, real = [], network.components
    monkeypatch.setattr(network, "components", lambda nodes, *rest, **named: asked.append(nodes) or real(nodes, *rest, **named))
    queries.damaged_links(spark, SF_DIR).count()
    m = queries.adapters.road_members(spark, SF_DIR)
    most = network.nodes_of(network.build_links(m)).count()
    assert len(asked) == 2 and all(nodes.distinct().count() < most for nodes in asked)


def test_members_are_not_written_before_their_components_are_found(spark, monkeypatch):
    written, real = [], network.components
    monkeypatch.setattr(network, "components", lambda nodes, edges, local=0, written_=False, **named: written.append(written_) or real(nodes, edges, local, written_, **named))
    queries.settlement_status(spark, SF_DIR).count()
    assert written == [True] * 3


def test_detours_are_found_for_hospitals_alone(spark, monkeypatch):
    asked, real = [], network.routes
    monkeypatch.setattr(network, "routes", lambda destinations, *rest: asked.append(destinations) or real(destinations, *rest))
    assert queries.detours(spark, SF_DIR).count() > 0
    assert [{r["class"] for r in d.select("class").distinct().collect()} for d in asked] == [{"hospital"}]


def test_routes_need_no_merged_links(spark, monkeypatch):
    told = sorted(tuple(r) for r in queries.nearest_routes(spark, SF_DIR).collect())
    monkeypatch.setattr(network, "build_links", lambda *_: (_ for _ in ()).throw(AssertionError("all columns of all links")))
    assert sorted(tuple(r) for r in queries.nearest_routes(spark, SF_DIR).collect()) == told and told


def test_only_places_carry_values_to_the_search_for_bridges(spark, monkeypatch):
    sent, real = [], paths.bridge_sums
    monkeypatch.setattr(paths, "bridge_sums", lambda links, valued, *rest: sent.append(valued) or real(links, valued, *rest))
    assert impact.latent_bridges(spark, SF_DIR).count() > 0
    assert sent[0].where("hospitals + towns + villages + town_subjects = 0").count() < sent[0].count() / 2
