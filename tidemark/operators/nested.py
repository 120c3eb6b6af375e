"""Deeply nested records to flat tables, by Merkle identities of their parts.

Every object is canonicalised and hashed bottom-up: its hash covers its scalars and the hashes of its children.
Identical objects are stored once as a node; each place where one occurs is kept as a bridge row from its parent with
field and ordinal, and each record as a root row. The elements of a list are bridged from the object that holds it.
The flat rows that a part of a record stands for are told once per distinct part, while it is hashed; records get them
by walking their bridges.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, spread

FLAT = "array<struct<child_table:string,parent_key:string,child_key:string>>"
ROWS = f"kind string, record_id long, id binary, parent binary, field string, ordinal int, attrs map<string,string>, flat {FLAT}"
ARROW = pa.schema([
    ("kind", pa.string()), ("record_id", pa.int64()), ("id", pa.binary()), ("parent", pa.binary()), ("field", pa.string()), ("ordinal", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("flat", pa.list_(pa.struct([("child_table", pa.string()), ("parent_key", pa.string()), ("child_key", pa.string())]))),
])
TAGS = {type(None): b"0", bool: b"?", int: b"=", float: b".", str: b"s", list: b"]"}
TOKEN = re.compile(r"[ \t\n\r]*(?:([{}\[\],:])|(\")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity))")
Flatten = Callable[[str, dict], list[tuple[str, str, str]]]


def parse(text: str) -> object:
    """JSON of any depth; beyond what the usual parser takes, with a stack of its own."""
    try:
        return json.loads(text)
    except RecursionError:
        return _deep(text)


def _deep(text: str) -> object:
    top: list = []
    stack: list[tuple[object, str | None]] = [(top, None)]
    at, want, text = 0, "value", text.rstrip(" \t\n\r")
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or not stack or (len(stack) == 1 and top):
            raise ValueError(f"no JSON at {at}")
        mark, at = m[1], m.end()
        holder = stack[-1][0]
        if mark in ("}", "]"):
            if want not in ("more", "first") or len(stack) == 1 or isinstance(holder, dict) != (mark == "}"):
                raise ValueError(f"{mark} at {at}")
            stack.pop()
            want = "more"
            continue
        if mark in (",", ":"):
            if want != ("more" if mark == "," else "colon") or len(stack) == 1:
                raise ValueError(f"{mark} at {at}")
            want = "key" if mark == "," and isinstance(holder, dict) else "value"
            continue
        if want in ("more", "colon"):
            raise ValueError(f"value at {at}")
        if m[2]:
            value, at = scanstring(text, at, True)
        else:
            value = {} if mark == "{" else [] if mark == "[" else json.loads(m[3])
        if isinstance(holder, dict) and want in ("first", "key"):
            if not m[2]:
                raise ValueError(f"key at {at}")
            stack[-1], want = (holder, value), "colon"
            continue
        if isinstance(holder, dict):
            holder[stack[-1][1]] = value
        else:
            holder.append(value)
        want = "more"
        if mark:
            stack.append((value, None))
            want = "first"
    if len(stack) != 1 or not top:
        raise ValueError("no complete JSON")
    return top[0]


def _text(value: object) -> str | None:
    """A scalar as text; true, false, numbers and lists of scalars as in JSON."""
    if value is None or type(value) is str:
        return value
    return str(value) if type(value) is int else json.dumps(value)


def objects(value: object) -> list[dict]:
    """The objects of a field: its own, or one for each element of a list that has any object or list; an element that
    is no object becomes one with an empty field name."""
    if isinstance(value, dict):
        return [value]
    if isinstance(value, list) and any(type(e) in (dict, list) for e in value):
        return [e if isinstance(e, dict) else {"": e} for e in value]
    return []


def scalar(value: dict, field: str) -> str | None:
    """A scalar field as text; null where it is missing, null or holds objects."""
    x = value.get(field)
    return None if x is None or objects(x) or isinstance(x, dict) else _text(x)


def unwrap(value: object, envelope: tuple[str, ...]) -> list[object]:
    """The records inside envelope fields, which may be nested, hold a list or be JSON written as a string."""
    out, left = [], [value]
    while left:
        value = left.pop()
        while isinstance(value, dict) and (inside := [f for f in envelope if f in value]):
            value = value[inside[0]]
            if isinstance(value, str):
                value = parse(value)
        if isinstance(value, list):
            left.extend(reversed(value))
        else:
            out.append(value)
    return out


class Merkle:
    """Nodes and bridges of a batch; what was already told in the batch isn't again. Lists of scalars only are scalars.
    ``clean``: lone surrogates, which can't be stored as UTF-8, become question marks."""

    def __init__(self, flatten: Flatten | None = None) -> None:
        self.rows: list[tuple] = []
        self.seen: set[bytes] = set()
        self.told: set[tuple[str, bytes]] = set()
        self.flatten = flatten
        self.clean = False
        self.names: dict[str, bytes] = {}

    def _utf8(self, text: str) -> str:
        return text.encode("utf-8", "replace").decode() if self.clean else text

    def add(self, value: dict) -> bytes:
        """The identity of an object of any depth. The digest takes fields in sorted order with type-tagged scalars, so
        that neither the order nor the spelling of JSON matters, while ``1`` and ``"1"``, or an object and a list of it,
        differ."""
        order, left = [], [value]
        while left:
            x = left.pop()
            fields, kids = sorted(x), []
            for f in fields:
                if type(v := x[f]) is dict:
                    kids.append((f, 0, v))
                elif type(v) is list:
                    kids += [(f, i, o) for i, o in enumerate(objects(v))]
            order.append((x, fields, kids))
            left += [o for _, _, o in kids]
        known: dict[int, bytes] = {}
        while order:
            x, fields, kids = order.pop()
            body, attrs, held = [b"{"], [], {}
            for f, _, o in kids:
                held.setdefault(f, []).append(known[id(o)])
            for field in fields:
                v = x[field]
                if (name := self.names.get(field)) is None:
                    data = self._utf8(field).encode()
                    name = self.names[field] = len(data).to_bytes(4, "big") + data
                body.append(name)
                if field in held:
                    if type(v) is list:
                        body.append(b"[" + len(v).to_bytes(4, "big"))
                    body += [b"#" + k for k in held[field]]
                    continue
                text = _text(v)
                data = b"" if text is None else text.encode("utf-8", "replace")
                body.append(TAGS[type(v)] + len(data).to_bytes(4, "big") + data)
                attrs.append((self._utf8(field), text if text is None else self._utf8(text)) if self.clean else (field, text))
            me = known[id(x)] = hashlib.blake2b(b"".join(body), digest_size=16).digest()
            if me not in self.seen:
                self.seen.add(me)
                self.rows.append(("node", None, me, None, None, None, attrs, None))
                self.rows += [("bridge", None, known[id(o)], me, self._utf8(f), i, None, None) for f, i, o in kids]
        if self.flatten and ("", me) not in self.told:
            self.told.add(("", me))
            for f, i, o in kids:
                self.rows.append(("part", None, known[id(o)], me, self._utf8(f), i, None, None))
                if (f, known[id(o)]) not in self.told:
                    self.told.add((f, known[id(o)]))
                    if flat := self.flatten(f, o):
                        flat = [tuple(map(self._utf8, r)) for r in flat] if self.clean else flat
                        self.rows.append(("flat", None, known[id(o)], None, self._utf8(f), None, None, [dict(zip(("child_table", "parent_key", "child_key"), r, strict=True)) for r in dict.fromkeys(flat)]))
        return me


def decompose(batches: Iterator[pa.RecordBatch], envelope: tuple[str, ...], flatten: Flatten | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of ``record_id, payload`` to the tagged rows of :data:`ROWS`. A payload that isn't complete JSON
    gives nothing; all of it is parsed before any of its rows is told."""
    store = Merkle(flatten)
    for batch in batches:
        for record, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                found = unwrap(parse(payload), envelope) if payload else []
            except ValueError:
                continue
            if store.clean != (clean := bool(payload) and "\\ud" in payload.lower()):
                store.clean = clean
                store.names.clear()
            for i, x in enumerate(found):
                if isinstance(x, dict):
                    store.rows.append(("root", record, store.add(x), None, None, i, None, None))
            if len(store.rows) > 50_000:
                yield from _emit(store)
    yield from _emit(store)


def _emit(store: Merkle) -> Iterator[pa.RecordBatch]:
    if store.rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*store.rows), ARROW, strict=True)], schema=ARROW)
        store.rows.clear()
        store.seen.clear()
        store.told.clear()
        store.names.clear()


@dataclass(frozen=True)
class Decomposed:
    """``roots``: record_id, ordinal, id. ``nodes``: id, attrs; once each. ``bridges``: parent, field, ordinal, id; once
    for each place in each distinct parent. ``parts``: those of them that lead down from roots. ``flat``: id, field and
    the flat rows of a distinct part under that field."""

    roots: DataFrame
    nodes: DataFrame
    bridges: DataFrame
    parts: DataFrame
    flat: DataFrame

    def occurrences(self) -> DataFrame:
        """How often each top-level object occurs: ``id, records``."""
        return self.roots.groupBy("id").agg(F.count(F.lit(1)).alias("records"))


def match_rows(section: str, entry: dict) -> list[tuple[str, str, str]]:
    """``child_table, parent_key, child_key`` of one entry of a match's lineups, players or statistics. A key is the
    id as text, or the name where that is null; where it has neither, there is no row."""
    keys = lambda value: [k for x in objects(value) if (k := scalar(x, "id") if scalar(x, "id") is not None else scalar(x, "name")) is not None]
    teams, out = keys(entry.get("team")), []
    if section == "statistics":
        for g in objects(entry.get("statistics")):
            if "type" in g and not objects(g["type"]):
                names = [scalar(g, "type")] if scalar(g, "value") is not None else []
            else:
                names = [f for f in g if scalar(g, f) is not None]
            out += [("team_stat", t, n) for t in teams for n in names if n is not None]
    elif section in ("lineups", "players"):
        for s in [s for f in (("players",) if section == "players" else ("startXI", "substitutes")) for s in objects(entry.get(f))]:
            mine = keys(s.get("player")) if teams else []
            out += [("player" if section == "players" else "lineup", t, k) for t in teams for k in mine]
            if section == "players":
                out += [("player_stat", k, name) for k in mine for g in objects(s.get("statistics")) for name, x in g.items() if x is not None]
    return out


def merkle_tables(df: DataFrame, record_id: str, payload: str, envelope: tuple[str, ...] = ("response",), flatten: Flatten = match_rows) -> Decomposed:
    """Decomposes JSON texts. Parsing runs once, in Arrow batches; its rows are written to the shared checkpoint
    folder and the tables read from there, each with only the columns it needs. ``flatten`` gives the flat rows of a
    part by its field and content. Rows with a null id or payload give nothing; repeated rows give repeated roots over
    the same nodes."""
    source = df.select(F.col(record_id).cast("long").alias("record_id"), F.col(payload).cast("string").alias("payload")).where("record_id is not null and payload is not null")
    rows = cut(spread(source).mapInArrow(lambda it: decompose(it, envelope, flatten), ROWS))
    return Decomposed(
        rows.where("kind = 'root'").select("record_id", "ordinal", "id"),
        rows.where("kind = 'node'").groupBy("id").agg(F.first("attrs").alias("attrs")),
        rows.where("kind = 'bridge'").groupBy("parent", "field", "ordinal").agg(F.first("id").alias("id")),
        rows.where("kind = 'part'").groupBy("parent", "field", "ordinal").agg(F.first("id").alias("id")),
        rows.where("kind = 'flat'").groupBy("id", "field").agg(F.first("flat").alias("flat")),
    )


def match_children(parts: Decomposed) -> DataFrame:
    """``payload_id, child_table, parent_key, child_key``, distinct: the lineup, player, team_stat and player_stat rows
    of match payloads, by the bridges from their roots to the flat rows of each distinct part."""
    walked = parts.roots.select(F.col("record_id").alias("payload_id"), F.col("id").alias("parent")).distinct().join(parts.parts.select("parent", "field", "id").distinct(), "parent")
    return walked.select("payload_id", "field", "id").distinct().join(parts.flat, ["id", "field"]).select("payload_id", F.inline("flat")).distinct()
