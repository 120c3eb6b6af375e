import json

import pytest

from tidemark.operators.nested import Merkle, _deep, match_children, merkle_tables

MATCH = {
    "lineups": [{"team": {"id": 1}, "startXI": [{"player": {"id": 10, "name": "A"}}, {"player": {"id": None, "name": "B"}}], "substitutes": None}],
    "players": {"team": {"id": "1"}, "players": [{"player": {"id": 10}, "statistics": [{"games": {"minutes": 90}, "goals": None}]}, {"player": {"id": 11}, "statistics": {"cards": {}}}]},
    "statistics": [{"team": {"id": 1}, "statistics": [{"type": "Shots", "value": 3}, {"type": "Fouls", "value": None}]}, {"team": {"id": 2}, "statistics": {"Shots": "4", "Offsides": None}}],
}
WANT = {("lineup", "1", "10"), ("lineup", "1", "B"), ("player", "1", "10"), ("player", "1", "11"), ("player_stat", "10", "games"), ("player_stat", "11", "cards"), ("team_stat", "1", "Shots"), ("team_stat", "2", "Shots")}


def test_children_of_all_shapes(spark):
    text = json.dumps(MATCH)
    payloads = [(1, text), (2, json.dumps({"paging": {}, "response": [MATCH]})), (3, json.dumps({"response": text})), (3, json.dumps({"response": text})), (4, text[:-5]), (5, ""), (6, None), (7, "[]"), (8, "3"), (9, '{"lineups": null}'), (10, "{" * 5000)]
    df = spark.createDataFrame([(i, p, "clash", "clash") for i, p in payloads], "payload_id long, payload string, id string, field string")
    parts = merkle_tables(df, "payload_id", "payload")
    got = [tuple(r) for r in match_children(parts).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, *w) for i in (1, 2, 3) for w in WANT}
    assert {r.records for r in parts.occurrences().collect()} == {4, 1}
    assert parts.roots.where("record_id = 3").count() == 2


def test_empty(spark):
    df = spark.createDataFrame([], "payload_id long, payload string")
    assert match_children(merkle_tables(df, "payload_id", "payload")).count() == 0


def test_identities():
    m = Merkle()
    assert m.add({"a": 1, "b": [{"x": None}]}) == m.add(json.loads('{"b": [{"x": null}],\n "a": 1}'))
    assert m.add({"a": 1}) != m.add({"a": "1"}) != m.add({"a": [1]})
    assert m.add({"a": {"b": 1}}) != m.add({"a": [{"b": 1}]})
    assert m.add({"a": [{"b": 1}, {"b": 2}]}) != m.add({"a": [{"b": 2}, {"b": 1}]})
    nodes = [r for r in m.rows if r[0] == "node"]
    assert len(nodes) == len({r[2] for r in nodes})


def test_very_long_payload(spark):
    big = json.dumps({"players": {"team": {"id": 1}, "players": [{"player": {"id": i}} for i in range(60_000)]}})
    df = spark.createDataFrame([(1, big)], "payload_id long, payload string")
    assert match_children(merkle_tables(df, "payload_id", "payload")).count() == 60_000


def test_any_depth(spark):
    deep = json.dumps(MATCH)[:-1] + ', "venue": ' + '{"inside": [' * 6000 + '{"players": 1}' + "]}" * 6000 + "}"
    cut_off = deep[:-1]
    df = spark.createDataFrame([(1, deep), (2, cut_off), (3, "[" * 30_000 + "]" * 30_000)], "payload_id long, payload string")
    parts = merkle_tables(df, "payload_id", "payload")
    assert {tuple(r) for r in match_children(parts).collect()} == {(1, *w) for w in WANT}
    assert parts.nodes.count() > 6000


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, null, true, {"b\\n": "\\u00e9\\ud83d\\ude00"}, [], {}], "c": ""}', "[]", " 3 ", '"x"', '{"a": 1, "a": 2}'])
def test_own_parser_reads_what_the_usual_one_does(text):
    assert _deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a" 1}', '{"a": 1,}', "[1 2]", "1 2", "{]", '{1: 2}', '["a', "]", '{"a":}', "[,1]", "nul"])
def test_own_parser_refuses_what_the_usual_one_does(text):
    with pytest.raises(ValueError):
        _deep(text)
